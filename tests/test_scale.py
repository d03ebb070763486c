"""What keeps plans within their limits on larger tables."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from korvex import queries as Q
from korvex.client import IndexClient
from korvex.functions import text as T
from korvex.operators import chunking, embedding
from korvex.operators import retrieval as R
from korvex.plans import util

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normalising_needs_no_python(spark):
    df = spark.createDataFrame([(0, "  é\r\nx\ry\x85 "), (1, None), (2, "가"), (3, "")], "k int, t string")
    out = df.select("k", T.normalize(F.col("t")).alias("n"))
    assert "Python" not in plan(out) and {r.k: r.n for r in out.collect()} == {0: "é\nx\ny", 1: None, 2: "가", 3: ""}


def test_windows_with_some_columns_only(spark):
    df = spark.createDataFrame([(str(k), "é word\n" * 500 * k, k) for k in range(4)], "id string, body string, x bigint").coalesce(1)
    whole = {(r.document_id, r.ordinal): r for r in chunking.chunk(df).collect()}
    for own in (["ordinal", "occurrence"], ["ordinal", "content_hash", "occurrence"], ["ordinal", "text", "token_end"]):
        some = chunking.chunk(df, columns=own, keep=("x",))
        assert some.columns == ["document_id", *own, "x"]
        rows = some.collect()
        assert len(rows) == len(whole) and all(r.x == int(r.document_id) and all(r[c] == whole[r.document_id, r.ordinal][c] for c in own) for r in rows)


def test_hashed_words_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, "a b a"), (1, "b"), (2, ""), (3, None)], "k bigint, t string").repartition(3, "t")
    out = embedding.buckets(df, "k", "t")
    assert sorted(round(r.weight, 6) for r in out.collect()) == [0.707107, 0.707107]  # rows of one id are one text
    assert plan(embedding.buckets(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text")).count("Exchange hashpartitioning") == 1 or not os.path.exists(DATA)


def test_many_queries_take_little_memory():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((10_000, 8)), rng.standard_normal((4000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x))], ["chunk_id", "embedding"])
    tracemalloc.start()
    out = list(R._top(q, pa.array(range(len(q))), 5, 6)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # one product of all would be 320 MB, and its copies
    for k in (0, 17, 3999):
        s = np.round(x @ q[k], 6)
        want = sorted(range(len(x)), key=lambda j: (-s[j], j))[:5]
        assert [r["chunk_id"] for b in out for r in b.to_pylist() if r["query_id"] == k] == want


def test_batches_of_keyword_queries_against_single_postings(spark):
    words = "sun moon star sea hill the of and flying flies".split()
    rng = np.random.default_rng(5)
    docs = [(f"c{k:03}", " ".join(rng.choice(words, 1 + k % 30)), "a" if k % 3 else "b") for k in range(700)] + [("empty", "", "a")]
    df = spark.createDataFrame(docs, "chunk_id string, t string, side string").repartition(3)
    ask = spark.createDataFrame([(k, " ".join(rng.choice(words, 5))) for k in range(9)] + [(9, "absent"), (10, "")], "query_id int, query string")
    for stem in (False, True):
        rows = R.counted(df, F.col("t"), ["chunk_id", "side"], stem)
        assert "Exchange" not in plan(R.counted(df.sparkSession.createDataFrame(docs, df.schema), F.col("t"), ["chunk_id"], stem))
        index = R.postings(df, F.col("t"), stem=stem)
        stats = tuple(R.corpus_stats(df, index).first())
        for own in (None, "side = 'a'"):
            pool = None if own is None else df.where(own)
            want = {tuple(r) for r in R.keyword_channel(ask, index, stats, pool, 7, stem, 6).collect()}
            for limit in (1, R.BROADCAST_LIMIT):  # a block for each query, and one for all
                got = R.keyword_rows(ask, rows, stats, 7, None if own is None else rows.where(own), stem, 6, limit)
                assert {tuple(r) for r in got.collect()} == want and len(want) == 63


@given
@pytest.mark.parametrize("name", ["sort_orders_10", "exact_like_escape"])
def test_what_needs_no_terms_builds_no_index(spark, monkeypatch, name):
    monkeypatch.setattr(Q, "_index", None)
    assert Q.QUERIES[name](spark, DATA).count() > 0


@given
def test_the_index_has_no_texts(spark):
    assert "text" not in Q._index(spark, DATA)[0].columns


def test_an_ingest_leaves_no_tables_and_takes_the_last_of_an_id(spark, tmp_path):
    rows = [("a", "old", 1), ("a", "new", 2), ("b", "x", 1), (None, "y", 1), (None, "z", 2)]
    before = len(util._written.paths)
    client = IndexClient(spark, str(tmp_path / "i"), embedding.HashingEmbedder(8))
    assert client.ingest(spark.createDataFrame(rows, "id string, body string, seq bigint").repartition(4)) == {"accepted": 2, "failed": 1}
    assert len(util._written.paths) == before
    assert {(r.document_id, r.text) for r in client.corpus.read("chunks").collect()} == {("a", "new"), ("b", "x")}
