import numpy as np
import pytest
from pyspark.sql import functions as F

from korvex.llm import ann


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), None if v is None else [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")


def brute(x, k):
    x = x.astype(np.float32).astype(np.float64)
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
        out[i] = [(j, round(float(d[j]), 6)) for j in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.vec_id, r["rank"])):
        out.setdefault(r.vec_id, []).append((r.neighbour_id, r.distance))
    return out


def recall(got, want):
    hits = sum(len({j for j, _ in want[i]} & {j for j, _ in got.get(i, [])}) for i in want)
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["sphere", "clusters", "scaled"])
def test_recall_over_many_shards(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24))
    if kind == "clusters":
        x = x * 0.2 + rng.standard_normal((30, 24))[rng.integers(0, 30, 1500)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "scaled":
        x = x * 1000 + 5000
    got = result(ann.neighbours(frame(spark, x), k=5, shard=100))
    assert recall(got, brute(x, 5)) >= 0.93


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_through_hashing_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute(np.array([r.embedding for r in rows]), ann.K)
    got = result(ann.query(spark, f"/root/testdata/{sf}"))
    assert [r.vec_id for r in rows] == list(range(len(rows))) and set(got) == set(range(0, len(rows), 50))
    assert recall(got, {i: want[i] for i in got}) >= 0.9
    assert all(dict(want[i]).get(j, d) == pytest.approx(d, abs=1e-6) for i in got for j, d in got[i])


def test_perturbations_come_by_falling_chance_and_once():
    rng = np.random.default_rng(6)
    chance = -np.sort(-rng.random((4, 5)), axis=1)
    code = rng.permutation(20).reshape(4, 5) * 100**0 + np.arange(4)[:, None] * 1000
    got = list(ann.best_first(chance.tolist(), code.tolist()))
    want = sorted((float(np.prod([chance[r, c[r]] for r in range(4)])), int(sum(code[r, c[r]] for r in range(4)))) for c in np.ndindex(5, 5, 5, 5))
    assert len(got) == 625 and all(x[0] >= y[0] - 1e-12 for x, y in zip(got, got[1:]))
    assert np.allclose(sorted(x[0] for x in got), [w[0] for w in want]) and sorted(x[1] for x in got) == sorted(w[1] for w in want)


def test_clusters_visit_few_buckets():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((4000, 16)) * 0.02 + rng.standard_normal((100, 16))[rng.integers(0, 100, 4000)]).astype(np.float32)
    h = ann.Hasher(16, 10**6, x.mean(axis=0), float(x.std()))
    counts = [(t, int(c), int(n)) for t in range(2) for c, n in zip(*np.unique(h.codes(x, t), return_counts=True))]
    visits = ann.Directory(h, counts, 100).visits(x[:200], np.full(200, 0.1), 0, 0.1)
    assert all(visits) and np.mean([len(v) for v in visits]) < 0.1 * len([c for c in counts if not c[0]])


def test_text_ids(spark):
    df = frame(spark, [[0.0], [1.0], [5.0], [5.5]]).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("vec_id"), "embedding", F.create_map(F.lit("a"), F.lit(1)).alias("kx_n"))
    assert result(ann.neighbours(df, k=1, asked=F.col("vec_id") != "v0")) == {"v1": [("v0", 1.0)], "v2": [("v3", 0.5)], "v3": [("v2", 0.5)]}
    assert dict(ann.neighbours(df.limit(0)).dtypes)["vec_id"] == "string"


def test_ties_repeats_and_bad_rows(spark):
    same = [[1.0, 0.0]] * 40
    rows = [*same, [0.0, 1.0], None, [1.0], [float("nan"), 0.0]]
    df = frame(spark, rows).unionByName(frame(spark, [[1.0, 0.0], [9.0, 9.0]], [0, 1])).withColumn("ID", F.lit("x")).withColumn("vec", F.lit("y"))
    df = df.unionByName(spark.createDataFrame([(None, [1.0, 1.0], "x", "y")], df.schema))
    for shard in (8, None):
        got = result(ann.neighbours(df, k=3, shard=shard))
        assert set(got) == set(range(41))
        assert got[0] == [(2 if j == 0 else j, 0.0) for j in (1, 2, 3)]
        assert got[40][0][1] == round(2**0.5, 6)


def test_equal_vectors_take_the_smaller_ids(spark):
    got = result(ann.neighbours(frame(spark, [[1.0, 2.0]] * 200), k=3, shard=10))
    assert len(got) == 200 and all(len(v) == 3 and all(d == 0 for _, d in v) for v in got.values())


def test_empty_and_few(spark):
    assert ann.neighbours(frame(spark, [])).count() == 0
    assert ann.neighbours(frame(spark, [[1.0]])).count() == 0
    assert result(ann.neighbours(frame(spark, [[1.0], [3.0]]))) == {0: [(1, 2.0)], 1: [(0, 2.0)]}
