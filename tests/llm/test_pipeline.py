import os

import pytest

import corpus_pipeline
from korvex.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returns, each on the one before."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    assert all(s.columns == COLUMNS for s in stages[:-1])
    docs, good, exact, near, mixed, packed = ([r for r in s.collect()] for s in stages)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    ids = {r.doc_id for r in good}
    right = [(r.doc_id in ids) == (labels[r.doc_id] > 0) for r in docs if r.doc_id in labels]
    assert sum(right) > 0.95 * len(right) and len(good) < len(docs)
    texts = {}
    for r in good:
        texts.setdefault(r.text, []).append(r.doc_id)
    assert sorted(r.doc_id for r in exact) == sorted(min(v) for v in texts.values())
    # Brute force over the fingerprints: one of each group of near copies stays.
    import numpy as np

    from korvex.llm import simhash

    signer = simhash.Signer()
    fps = {r.doc_id: np.frombuffer(s, np.uint64) for r in exact if (s := signer.sign(r.text))}
    root = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if j < i and int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= simhash.RADIUS:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    kept = {r.doc_id for r in near}
    assert kept == {r.doc_id for r in exact if root.get(r.doc_id, r.doc_id) == r.doc_id}
    assert len(mixed) == len(near) and {r.doc_id for r in mixed} <= kept
    lengths = {r.doc_id: len(r.text.split()) + 1 for r in mixed}
    words = sum(r.length for r in packed)
    assert words == sum(lengths[r.doc_id] for r in mixed)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    cur = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[columns.index(c)] for c in df.columns) for r in cur.fetchall()) == sorted(map(tuple, df.collect()))


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_stages_with_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty, long and repeated texts, extra columns with names that stages use."""
    prose = "Plain prose goes here, line by line, and ends well.\nAnother line of words follows the first one."
    rows = [(i, f"{prose} Number {i} has {i * 7} of them, {'so ' * (i % 5)}it goes.", "en", f"s{i % 3}", 10) for i in range(40)]
    rows += [(None, prose, None, None, None), (50, None, "en", "s1", None), (51, "", None, "s1", 0), (1, rows[1][1], "en", "s1", 10), (52, prose + " more." * 50_000, "en", None, 1), (53, prose + " more." * 50_000, "en", "s9", 1), (None, None, None, None, None)]
    extra = "doc_id bigint, text string, lang string, source string, n_chars bigint, copies int, kx_gone string, fp bigint, `a.b` int, `KX_SIZE` int, bin int"
    docs = spark.createDataFrame([(*r, 3, "g", 4, 5, 6, 7) for r in rows], extra)
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(50, 0, 0), (None, 1, None), (7, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    n = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}")
        assert 0 < docs.count() <= n or k == 4, name
    assert docs.columns == ["pack_id", "place", "doc_id", "piece", "begin", "length"]
