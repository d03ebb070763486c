import itertools

import numpy as np
import pytest

from korvex.llm import quality
from korvex.llm.quality import LineField

DATA = "/root/testdata/sf0.1"


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw) or b" ", np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


@pytest.mark.parametrize("lengths", [[1], [3], [4, 1, 2], [5, 5]])
def test_marginals_against_all_labellings(lengths):
    rng = np.random.default_rng(sum(lengths))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    score, start, trans = rng.normal(size=len(owner)), 0.7, rng.normal(size=(2, 2))
    p, expected, log_z = quality.forward_backward(score, owner, start, trans)
    want_p, want_e, want_z, at = [], np.zeros((2, 2)), 0.0, 0
    for n in lengths:
        s, total, marg, pairs = score[at : at + n], 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(s[k] for k in range(n) if y[k]) + start * y[0] + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            marg += w * np.array(y)
            for k in range(n - 1):
                pairs[y[k], y[k + 1]] += w
        want_p += list(marg / total)
        want_e += pairs / total
        want_z += np.log(total)
        at += n
    assert np.allclose(p, want_p) and np.allclose(expected, want_e) and np.isclose(log_z, want_z)


def test_features_do_not_depend_on_chunks():
    texts = ["One line\nanother  line!!\n", "", "\n\n", "no no no\n\tend", "é" * 50 + "\n1234"]
    field = LineField(np.linspace(-1, 1, 3 * quality.OWN), 0.3, np.array([[0.5, -0.2], [0.1, 0.4]]))
    whole = field.quality(*buffers(texts))
    assert np.allclose(whole, [field.quality(*buffers([t]))[0] for t in texts])
    assert whole[1] == 0 and whole[2] == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    train, test = [r for k, r in enumerate(rows) if k % 2], [r for k, r in enumerate(rows) if not k % 2]
    seen = {r.text for r in train}
    test = [r for r in test if r.text not in seen]
    field = LineField.fit([r.text for r in train], [r.quality > 0 for r in train])
    keep = field.quality(*buffers([r.text for r in test])) >= quality.THRESHOLD
    good = np.array([r.quality > 0 for r in test])
    assert (keep == good).mean() > 0.95 and keep[good].mean() > 0.97


def test_nulls_empties_columns_and_no_labels(spark):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    texts = ["Plain prose goes here, line by line.\nIt ends." if i % 2 else "!!! | $$ 99 | !!! |" for i in range(40)]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)] + [(100, None, 1, "q"), (101, "", 1, "q"), (None, texts[1], 1, "q"), (1, texts[1], 1, "q"), (102, texts[1] * 20_000, 1, "q")], "doc_id bigint, text string, kx_quality int, `a.b` string")
    out = {r.doc_id: r for r in quality.qualities(df, labels).collect()}
    assert out[100].quality == out[101].quality == 0 and not out[100].keep
    assert out[1].keep and not out[0].keep and out[None].quality == out[1].quality
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 23
    assert quality.qualities(df.limit(0), labels).count() == 0
    assert quality.qualities(df, labels.limit(0)).count() == df.count()


def test_repeated_training_ids_and_text_ids(spark):
    good, bad = "A calm line of words.\nAnother calm line here.\n", "!!!! 1111 |||| ####\n@@@@ 2222\n"
    rows = [(f"d{i}", good if i % 2 else bad, {"k": i}) for i in range(40)]
    df = spark.createDataFrame(rows + [("d1", bad, None), ("d0", good, None)], "doc_id string, text string, extra map<string, int>")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)] + [("d1", 0), (None, 1)], "doc_id string, quality int")
    a, b = (quality.train(d, labels) for d in (df, df.repartition(7)))
    assert np.array_equal(a.weights, b.weights)
    got = {(r.doc_id, r.quality) for r in quality.qualities(df, labels).collect()}
    assert len(got) == 42
    assert all((q > 0.5) == (int(i[1:]) % 2 == 1) for i, q in got if i not in ("d0", "d1"))


def test_gradient_is_that_of_one_likelihood():
    rng = np.random.default_rng(2)
    owner, score, weight = np.array([0, 0, 0, 1, 2, 2]), rng.standard_normal(6), np.array([0.2, 0.2, 0.2, 0.5, 0.1, 0.1])
    trans = rng.standard_normal((2, 2))
    _, expected, _ = quality.forward_backward(score, owner, 0.3, trans, weight)
    numeric = np.zeros((2, 2))
    for i, j in np.ndindex(2, 2):
        for sign in (1, -1):
            t = trans.copy()
            t[i, j] += sign * 1e-5
            total = sum(w * quality.forward_backward(score[owner == d], owner[owner == d], 0.3, t)[2] for d, w in ((0, 0.2), (1, 0.5), (2, 0.1)))
            numeric[i, j] += sign * total / 2e-5
    assert np.allclose(expected, numeric, atol=1e-5)
