from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from korvex.llm import packing

DOCS = "doc_id bigint, text string"


def words(n):
    return " ".join(["w"] * n)


def check(rows, docs, window, granule):
    """The invariants of every packing: all words once, no window too full, places in order."""
    want = Counter()
    for i, text in docs:
        n = len((text or "").split()) and len((text or "").split()) + 1
        for k in range(-(-n // window)):
            want[(i, k, k * window, min(window, n - k * window))] += 1
    assert Counter((r.doc_id, r.piece, r.begin, r.length) for r in rows) == want
    packs = defaultdict(list)
    for r in rows:
        packs[r.pack_id].append(r)
    for own in packs.values():
        assert sum(-(-r.length // granule) * granule for r in own) <= window
        assert sorted(r.place for r in own) == list(range(len(own)))
    assert sorted(packs) == list(range(len(packs)))
    return packs


def test_brute_force_number_of_windows(spark):
    rng = np.random.default_rng(1)
    docs = [(i, words(int(n))) for i, n in enumerate(rng.integers(1, 90, 400))] + [(1000 + i, words(700)) for i in range(5)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS), window=64, granule=4, bucket=16).collect()
    packs = check(rows, docs, 64, 4)
    total = sum(-(-r.length // 4) * 4 for r in rows)
    # Best-fit decreasing, one piece at a time, needs no fewer windows by more than a few.
    rooms = []
    for length in sorted((-(-r.length // 4) * 4 for r in rows), reverse=True):
        fit = [k for k, x in enumerate(rooms) if x >= length]
        if fit:
            k = min(fit, key=lambda k: rooms[k])
            rooms[k] -= length
        else:
            rooms.append(64 - length)
    assert len(packs) <= 1.03 * len(rooms) + 1
    assert len(packs) * 64 <= 1.06 * total


def test_nnls_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((6, 4)), rng.standard_normal(6)
        x = packing.nnls(a.T @ a, a.T @ b)
        best = (np.linalg.norm(b), np.zeros(4))
        for mask in range(1, 16):
            at = [k for k in range(4) if mask >> k & 1]
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s >= 0).all():
                full = np.zeros(4)
                full[at] = s
                best = min(best, (np.linalg.norm(a @ full - b), full), key=lambda t: t[0])
        assert np.linalg.norm(a @ x - b) <= best[0] + 1e-8 and (x >= 0).all()


def test_combinations_fill_the_window():
    got = packing.combinations(12, 3)
    want = {(12,)} | {(a, 12 - a) for a in range(1, 7)} | {(a, b, 12 - a - b) for a in range(1, 13) for b in range(a, 13) if 12 - a - b >= b}
    assert set(got) == want and len(got) == len(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=24))
def test_plan_uses_up_the_histogram(histogram):
    h = np.array(histogram)
    used = Counter()
    for lengths, n in packing.plan(h):
        assert n > 0 and sum(lengths) <= len(h)
        for x in lengths:
            used[x] += n
    assert all(used[k + 1] == n for k, n in enumerate(h))


def test_nulls_empties_repeats_and_clashing_columns(spark):
    docs = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (4, "one"), (None, "two words"), (5, words(5000))]
    df = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], DOCS + ", bin int, pack_id int, length string")
    check(packing.pack(df).collect(), docs, 2048, 16)
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(df.where("text IS NULL")).count() == 0


def test_same_rows_from_other_partitions(spark):
    docs = [(i, words(i % 37 + 1)) for i in range(300)]
    df = spark.createDataFrame(docs, DOCS)
    one, two = (sorted(map(tuple, packing.pack(x, 64, 4).collect())) for x in (df.repartition(7), df.coalesce(1)))
    assert one == two


def test_text_ids_and_map_columns(spark):
    df = spark.createDataFrame([("a", "one two three", {"k": 1}), (None, "four", None), ("b", None, None)], "doc_id string, text string, extra map<string, int>")
    got = packing.pack(df, window=16, granule=4).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("None", 2), ("a", 4)]
