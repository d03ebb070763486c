import hashlib
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from korvex.llm import mixing

DOCS = "doc_id bigint, text string, source string"


def brute(rows, weights=None, total=None, seed=17):
    """Draws by largest remainders, then Pareto ranks, source by source."""
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i, math.isqrt(len(t or "")) + 1))
    total = len(rows) if total is None else total
    w = {s: int(math.sqrt(len(v) * 1e6)) if weights is None else round(weights.get(s, 0) * 1e6) for s, v in by.items()}
    everything = sum(w.values())
    parts = {s: divmod(total * w[s], everything) for s in by}
    left = total - sum(p[0] for p in parts.values())
    order = sorted(by, key=lambda s: (-parts[s][1], s is not None, s or ""))
    out = {}
    for rank, s in enumerate(order):
        n, size = parts[s][0] + (rank < left), sum(e for _, e in by[s])
        keys = []
        for i, e in by[s]:
            whole, rest = divmod(n * e, size)
            out[i] = whole
            if rest:
                u = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:12], 16)
                keys.append(((u / (mixing.SPAN - u)) / (rest / (size - rest)), i))
        certain = sum(n * e // size for _, e in by[s])
        for _, i in sorted(keys)[: n - certain]:
            out[i] += 1
    return {i: c for i, c in out.items() if c}


ROWS = [(i, "x" * (i * 37 % 500), ["a", "b", "c", None][0 if i < 300 else i % 4]) for i in range(420)]


def got(spark, rows, **options):
    return {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, DOCS), **options).collect()}


def test_against_brute_force(spark):
    assert got(spark, ROWS) == brute(ROWS)
    assert sum(got(spark, ROWS).values()) == len(ROWS)


def test_weights_and_total(spark):
    w = {"a": 0.2, "b": 0.5, "c": 0.3}
    out = got(spark, ROWS, weights=w, total=1000)
    assert out == brute([r for r in ROWS if r[2]], w, 1000)
    sources = {i: s for i, _, s in ROWS}
    sums = Counter()
    for i, c in out.items():
        sums[sources[i]] += c
    assert sums == {"a": 200, "b": 500, "c": 300}


def test_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix(empty).count() == 0
    rows = [(1, None, "a"), (1, None, "a"), (None, "", None), (2, "y" * 100_000, "a")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], DOCS + ", kx_u int, `n.b` string")
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copies"]
    assert out.agg(F.sum("copies")).first()[0] == 4
    assert mixing.repeat(out).columns == df.columns and mixing.repeat(out).count() == 4


def test_same_from_other_partitions(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).collect())) == sorted(map(tuple, mixing.mix(df.coalesce(1)).collect()))


def test_sums_beyond_64_bits_and_map_columns(spark):
    rows = [(i, "x" * (i % 90), "s", {"k": i}) for i in range(300)] + [(None, "y", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra map<string, int>")
    out = mixing.mix(df, total=301)
    assert out.agg(F.sum("copies")).first()[0] == 301 and "extra" in out.columns
    assert mixing.repeat(out).count() == 301
    # The rests of a source: 2^40 rows of up to 2^40 each, in parts.
    big = spark.range(4).select(F.lit(2**62).alias("r")).agg(F.sum(F.col("r").cast("decimal(20,0)")).alias("rests"))
    assert int(big.first().rests) == 2**64
