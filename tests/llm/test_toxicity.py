from itertools import combinations

import numpy as np
import pytest

from korvex.llm import toxicity
from korvex.llm.toxicity import LAMBDA, SpanMachine

DATA = "/root/testdata/sf0.1"


def kernel(a, b):
    """Common subsequences of three letters, by enumeration."""

    def raw(x, y):
        return sum(LAMBDA ** (i[2] - i[0] + 1 + j[2] - j[0] + 1) for i in combinations(range(len(x)), 3) for j in combinations(range(len(y)), 3) if all(x[p] == y[q] for p, q in zip(i, j)))

    return raw(a, b) / np.sqrt(raw(a, a) * raw(b, b))


def test_kernel_against_enumeration():
    words = ["idiot", "idxiot", "iddiot", "worthless", "banana", "abc"]
    got = toxicity.kernels(words, words)
    assert np.allclose(got, [[kernel(a, b) for b in words] for a in words], atol=1e-6)
    assert got[0, 1] > 0.6 and got[0, 3] < 0.2


def test_folded_machine_against_kernels():
    machine = SpanMachine.fit(["idiot", "worthless", "moron"], ["ideal", "worth", "ratio", "tomorrow", "banana"] * 3)
    keys, v = toxicity.subsequences("idiott")
    assert np.isclose(machine.scores(["idiott"], exact=True)[0], machine.table[keys] @ v + machine.bias, atol=1e-4)
    bad, good = machine.scores(["idxiot", "wortthless", "m0ron".replace("0", "o")]), machine.scores(["ideal", "banana", "ratio"])
    assert bad.min() > 0 > good.max()


def test_spans():
    assert toxicity.spans_of_word("i.d.i.o.t!") == ["idiot"] and toxicity.spans_of_word("1d10t") == ["idiot"]
    assert toxicity.runs("you i d i o t there") == ["idiot"]
    assert all(len(s) <= toxicity.WINDOW for s in toxicity.spans_of_word("x" * 100_000))


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()


def test_held_out_precision_and_recall(labelled):
    train, test = [r for k, r in enumerate(labelled) if k % 2], [r for k, r in enumerate(labelled) if not k % 2]
    seen = {r.text for r in train}
    test = [r for r in test if r.text not in seen]
    machine = toxicity.fit([r.text for r in train], [r.toxic > 0 for r in train])
    found = np.array([f is not None for f in toxicity.TextScorer(machine).judge([r.text for r in test])])
    bad = np.array([r.toxic > 0 for r in test])
    assert found[bad].mean() > 0.9 and bad[found].mean() > 0.9
    # Inserted and separated letters are tolerated in the insults that the machine knows.
    marks = [m for m in machine.marks if len(m) > 5 and m.isascii()][:4]
    spaced = [f"you are {' '.join(m)} now" for m in marks]
    assert all(toxicity.TextScorer(machine).judge(spaced))


def test_length_and_label_sample_do_not_hide_insults():
    insults = ["zorgface", "blumhead", "quackwit"]
    toxic = [f"w{i} {insults[i % 3]} v{i}. calm words follow here" for i in range(60)]
    clean = [f"calm words w{i} follow here, and v{i} rest. " * 5 for i in range(120)]
    scorer = toxicity.TextScorer(toxicity.fit(toxic + clean, [True] * 60 + [False] * 120))
    for n in (5_000, 20_000):
        calm = "calm words follow here and rest. " * (n // 6)
        assert scorer.judge([calm, calm + "you zorgface now", calm + "a z o r g f a c e here"])[0] is None
        assert all(scorer.judge([calm + "you zorgface now", calm + "z o r g f a c e here", calm + " ".join(insults)]))


def test_an_insult_that_few_toxic_documents_have_is_learned():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(3000)]

    def text(*insults):
        own = list(rng.choice(words, 60))
        for k in insults:
            own.insert(int(rng.integers(len(own))), k)
        return ". ".join(" ".join(own[k : k + 10]) for k in range(0, len(own), 10))

    toxic = [text("blumhead") if i % 50 else text("quackwit") for i in range(1000)]  # 2 %
    clean = [text() for _ in range(1500)]
    machine = toxicity.fit(toxic + clean, [True] * 1000 + [False] * 1500)
    scorer = toxicity.TextScorer(machine)
    assert all(scorer.judge([text("quackwit"), text("quackkwit", "quacxkwit"), text("blumhead")])) and set(machine.marks) == {"blumhead", "quackwit"}
    assert sum(f is not None for f in scorer.judge([text() for _ in range(300)])) <= 1


def test_near_copies_are_no_evidence():
    copy = "the very same passage with a quibberly word in it"
    toxic = [f"{copy} number{i}. you zorgface w{i} x" for i in range(40)]
    machine = toxicity.fit(toxic + [f"calm words w{i} of v{i} x" for i in range(80)], [True] * 40 + [False] * 80)
    assert "quibberly" not in machine.marks and "zorgface" in machine.marks


def test_text_ids_and_order_of_rows(spark):
    rows = [(f"d{i}", f"w{i} zorgface v{i}. calm words follow here" if i < 30 else f"calm words w{i} follow here, and v{i} rest. " * 20, {"k": i}) for i in range(120)]
    df = spark.createDataFrame(rows + [(None, "you zorgface", None), ("d3", "zzz", None)], "doc_id string, text string, span map<string, int>")
    labels = spark.createDataFrame([(f"d{i}", int(i < 30)) for i in range(120)] + [("d1", 0)], "doc_id string, toxic int")
    got = sorted(str(r.doc_id) for r in toxicity.toxic_documents(df, labels).collect())
    assert got == sorted(["None", *(f"d{i}" for i in range(30))])
    assert np.array_equal(*(toxicity.train(d, labels).table for d in (df, df.repartition(5))))


def test_nulls_empties_repeats_and_names(spark):
    toxic = ["you {} zorgface {} now", "a {} zorgface {} again", "{} is a zorgface of {}"]
    rows = [(i, toxic[i % 3].format(f"w{i}", f"v{i}") + ". calm words follow here") for i in range(30)] + [(i, f"calm words w{i} follow here, and v{i} rest. " * 20) for i in range(30, 120)]
    labels = spark.createDataFrame([(i, 1, int(i < 30)) for i in range(120)] + [(None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    more = [(200, "zorgfface you"), (200, "zorgfface you"), (201, None), (202, ""), (203, "z o r g f a c e you"), (204, "zo"), (205, "q" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows + more], "doc_id bigint, text string, score int, span string")
    got = sorted(r.doc_id for r in toxicity.toxic_documents(df, labels).collect())
    assert got == [*range(30), 200, 200, 203]
    assert toxicity.toxic_documents(df.limit(0), labels).count() == 0
    assert toxicity.toxic_documents(df, labels.limit(0)).count() == 0
    assert toxicity.toxic_documents(df, labels.where("toxic = 0")).count() == 0
