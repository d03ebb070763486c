import numpy as np
from pyspark.sql import functions as F

from korvex.llm import exact_dedup
from korvex.llm.exact_dedup import CountingQuotientFilter

DOCS = "doc_id bigint, text string"


def test_filter_keeps_fingerprints_and_counts():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (5000, 300))
    a = np.concatenate([a, a[:700], np.array([0, 0, (1 << 64) - 1, 1, 2, 3], np.uint64)])
    both = CountingQuotientFilter.build(a).merge(CountingQuotientFilter.build(np.concatenate([b, a[:10]])))
    back = CountingQuotientFilter.from_bytes(both.to_bytes())
    keys, counts = np.unique(np.concatenate([a, b, a[:10]]), return_counts=True)
    for f in (both, back):
        got = f.decode()
        assert (got[0] == keys).all() and (got[1] == counts).all()
    assert all(back.count(int(k)) == n for k, n in zip(keys[:200], counts[:200]))
    assert back.count(12345) == 0


def test_filter_of_nothing_and_of_many_copies():
    none = CountingQuotientFilter.build(np.zeros(0, np.uint64))
    assert len(CountingQuotientFilter.from_bytes(none.to_bytes()).decode()[0]) == 0
    many = CountingQuotientFilter.build(np.full(1000, 7, np.uint64))
    assert CountingQuotientFilter.from_bytes(many.merge(none).to_bytes()).count(7) == 1000


def brute(rows):
    ids = {}
    for i, t in rows:
        if t is not None:
            ids.setdefault(t, []).append(i)
    return sorted((i, min(own)) for own in ids.values() if len(own) > 1 for i in own)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, ""), (7, ""), (8, "a"), (9, "x" * 200_000), (10, "x" * 200_000), (11, "A"), (12, "c"), (12, "c")]


def test_groups_against_brute_force(spark):
    got = exact_dedup.duplicate_groups(spark.createDataFrame(ROWS, DOCS))
    assert sorted(map(tuple, got.collect())) == brute(ROWS)


def test_collisions_are_told_apart_by_bytes(spark):
    got = exact_dedup.duplicate_groups(spark.createDataFrame(ROWS, DOCS), hash_col=F.lit(5).cast("bigint"))
    assert sorted(map(tuple, got.collect())) == brute(ROWS)
    kept = exact_dedup.drop_duplicates(spark.createDataFrame(ROWS, DOCS), hash_col=F.lit(5).cast("bigint"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6, 9, 11, 12]


def test_drop_keeps_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(i, t, 1, "k", i) for i, t in [*ROWS, (None, "a"), (None, "n")]], DOCS + ", kx_fp int, fp string, `odd.name` bigint")
    out = exact_dedup.drop_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 4, 5, 6, 9, 11, 12]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact_dedup.duplicate_groups(df).count() == 0 and exact_dedup.drop_duplicates(df).count() == 0


def test_map_columns_text_ids_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD", 8)
    rows = [(f"d{i:03d}", f"text {i % 40}" if i % 9 else None, {"k": i}) for i in range(200)] + [(None, "text 1", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, extra map<string, int>")
    want = {}
    for i, t, _ in rows:
        if t is not None:
            want.setdefault(t, []).append(i)
    kept = exact_dedup.drop_duplicates(df).collect()
    assert sorted((r.doc_id, r.extra["k"]) for r in kept if r.text is not None) == sorted((m, int(m[1:])) for m in (min(i for i in ids if i) for ids in want.values()))
    assert sum(r.text is None for r in kept) == sum(t is None for _, t, _ in rows)
    groups = {r.doc_id: r.group_id for r in exact_dedup.duplicate_groups(df).collect()}
    assert groups == {i: min(x for x in ids if x) for ids in want.values() if len(ids) > 1 for i in ids}
