"""Packing of documents into windows by non-negative least squares.

A document's length is its number of words and one for its end. Longer ones
than a window are cut into whole windows and a rest; the rest and all others
are pieces, whose lengths, rounded up to GRANULE, make a histogram. All shallow
combinations (up to DEPTH lengths) that fill a window exactly are the columns
of a matrix; non-negative least squares solves how often to repeat each so that
they use up the histogram, with less weight on lengths that are easy to place
later. The repeats are rounded, what they leave over (or overdraw) is packed
greedily, longest piece first into the fullest window that has room.

The plan is made on the histogram, which has WINDOW / GRANULE entries at any
size of the corpus. Pieces are numbered within their length, through buckets of
a hash so that no length is sorted in one place, and a piece's number tells its
window.

Defined results: null texts and texts without words have no piece; rows that
repeat are packed each; pieces of equal length are interchangeable and go by
hash, id and place; no rows in give no rows; ids may be null or have any type
that can be hashed; other columns may have any names and types.
"""

from __future__ import annotations

from itertools import combinations_with_replacement, count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvex.plans.util import BROADCAST_LIMIT, cut, quoted, table, written

#: Words of a window, the step of the histogram, and the most pieces of an enumerated combination.
WINDOW, GRANULE, DEPTH = 2048, 16, 3
#: Pieces that one bucket of a length has, about.
BUCKET = 20_000


def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Sorted lengths from 1, depth at most, that add up to bins exactly."""
    out = []
    for d in range(1, depth + 1):
        for head in combinations_with_replacement(range(1, bins // min(d, 2) + 1), d - 1):
            last = bins - sum(head)
            if last >= (head[-1] if head else 1):
                out.append((*head, last))
    return out


def nnls(gram: np.ndarray, target: np.ndarray, rounds: int | None = None, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |A x - b|, from A'A and A'b, by Lawson and Hanson's active sets.

    Goes on until no gradient is left above the tolerance: every round lowers
    the residual, so no active set comes twice. rounds is for tests.
    """
    n = len(target)
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds) if rounds is not None else count():
        gradient = target - gram @ x
        gradient[passive] = -np.inf
        k = int(gradient.argmax()) if n else 0
        if not n or gradient[k] <= tolerance:
            break
        passive[k] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=1e-12)[0]
            if s.min(initial=0) >= -tolerance:
                x[:] = 0
                x[at] = np.maximum(s, 0)
                break
            low = s < 0
            now = x[at]
            step = (now[low] / np.maximum(now[low] - s[low], 1e-300)).min()
            x[at] = np.maximum(now + step * (s - now), 0)
            drop = at[(x[at] <= 1e-12) & low]
            passive[drop if len(drop) else at[[int(s.argmin())]]] = False
            x[~passive] = 0
    return x


def greedy(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of counts left[length - 1], longest first; equal windows are handled together."""
    bins = len(left)
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(bins + 1)]  # by room: contents and their number
    for length in range(bins, 0, -1):
        n = int(left[length - 1])
        for space in range(length, bins):
            # Windows whose room grows small enough may take a second piece of this length below.
            while n and room[space]:
                held, m = next(iter(room[space].items()))
                take = min(n, m)
                if take == m:
                    del room[space][held]
                else:
                    room[space][held] = m - take
                now = (*held, length)
                room[space - length][now] = room[space - length].get(now, 0) + take
                n -= take
            if not n:
                break
        if n:
            each = bins // length
            whole, rest = divmod(n, each)
            for k, m in ((each, whole), (rest, 1)):
                if k and m:
                    now = (length,) * k
                    room[bins - k * length][now] = room[bins - k * length].get(now, 0) + m
    return [(held, n) for r in room for held, n in r.items()]


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of windows that hold the histogram's pieces exactly; histogram[k]: pieces of length k + 1."""
    bins = len(histogram)
    if not histogram.sum():
        return []
    # Only combinations whose lengths occur can be used.
    useful = [c for c in combinations(bins, depth) if all(histogram[x - 1] for x in c)]
    chosen: list[tuple[tuple[int, ...], int]] = []
    left = histogram.astype(np.int64).copy()
    if useful:
        scale = float(histogram.max())
        a = np.zeros((bins, len(useful)))
        for c, lengths in enumerate(useful):
            for x in lengths:
                a[x - 1, c] += 1
        # Short pieces fill gaps anyway: leaving them over costs little.
        weight = np.where(np.arange(1, bins + 1) <= bins // 16, 0.3, 1.0)[:, None]
        w = a * weight
        x = nnls(w.T @ w, w.T @ (histogram / scale * weight[:, 0])) * scale
        for c in np.argsort(-x, kind="stable"):
            if x[c] < 0.5:
                break
            lengths, need = useful[c], a[:, c].astype(np.int64)
            n = min(int(np.rint(x[c])), int((left[need > 0] // need[need > 0]).min()))  # rounding never overdraws
            if n > 0:
                chosen.append((lengths, n))
                left -= n * need
    return chosen + greedy(left)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\S+")).cast("bigint")


def pieces(docs: DataFrame, window: int, granule: int, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    """(doc_id, piece, begin, length, bin) of all pieces."""
    n = word_count(F.col(text_col).cast("string")) if length_col is None else F.col(length_col).cast("bigint")
    sized = docs.select(quoted(id_col).alias("doc_id"), (n + 1).alias("n")).where("n > 1")
    cuts = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {window}"))).alias("piece"))
    out = cuts.withColumn("begin", F.col("piece") * window).withColumn("length", F.least(F.col("n") - F.col("begin"), F.lit(window).cast("bigint")))
    return out.select("doc_id", "piece", "begin", "length", F.expr(f"CAST((length + {granule - 1}) div {granule} AS INT)").alias("bin"))


def _ranges(chosen: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, first, end, first pack, pieces of it in a window, place) for the numbered pieces of each bin.

    The pieces first to end of a bin fill windows one after another, as many to
    a window as it has of that bin.
    """
    used: dict[int, int] = {}
    out, pack = [], 0
    for lengths, n in chosen:
        place = 0
        for x in sorted(set(lengths), reverse=True):
            each = lengths.count(x)
            first = used.get(x, 0)
            used[x] = first + each * n
            out.append((x, first, used[x], pack, each, place))
            place += each
        pack += n
    return out


def pack(docs: DataFrame, window: int = WINDOW, granule: int = GRANULE, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, bucket: int = BUCKET) -> DataFrame:
    """(pack_id, place, doc_id, piece, begin, length): every piece and its window; begin and length count words.

    length_col: a column of docs with lengths of another kind, such as tokens.
    """
    if window % granule:
        raise ValueError("window must be a multiple of granule")
    spark = docs.sparkSession
    parts = written(pieces(docs, window, granule, id_col, text_col, length_col).withColumn("h", F.xxhash64("doc_id", "piece").bitwiseAND(F.lit((1 << 40) - 1))))
    bins = window // granule
    histogram = np.zeros(bins, np.int64)
    for r in parts.groupBy("bin").count().collect():  # WINDOW / GRANULE rows
        histogram[r["bin"] - 1] = r["count"]
    # Numbers of pieces within their bin: buckets of the hash, counted, then sorted each.
    fine = max(1, int(-(-histogram.max() // bucket)))
    parts = parts.withColumn("bucket", F.expr(f"CAST((h * {fine}) >> 40 AS INT)"))
    counts = parts.groupBy("bin", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(counts.select("bin", "bucket", F.coalesce(before, F.lit(0)).alias("start")))
    ranked = parts.withColumn("own", F.row_number().over(Window.partitionBy("bin", "bucket").orderBy("h", "doc_id", "piece", "length")) - 1)
    small = starts.count() * 32 <= BROADCAST_LIMIT
    ranked = ranked.join(F.broadcast(starts) if small else starts, ["bin", "bucket"]).withColumn("number", F.col("start") + F.col("own"))
    ranges = _ranges(plan(histogram, depth))
    columns = "bin int, first bigint, end bigint, base bigint, each bigint, place0 bigint"
    by_bin: dict[int, list] = {}
    for r in ranges:
        by_bin.setdefault(r[0], []).append(r)
    # A bin's ranges follow each other: one binary search in an array finds a number's range.
    table_ = spark.createDataFrame([(b, [tuple(r[1:]) for r in sorted(rs, key=lambda r: r[1])]) for b, rs in by_bin.items()], f"bin int, ranges array<struct<{', '.join(c.replace(' ', ':') for c in columns.split(', ')[1:])}>>")
    placed = ranked.join(F.broadcast(table_), "bin")  # as many rows as bins; the ranges are bounded by them too
    placed = placed.withColumn("r", F.expr("filter(ranges, r -> number >= r.first AND number < r.end)[0]"))
    offset = F.col("number") - F.col("r.first")
    return placed.select((F.col("r.base") + F.expr("(number - r.first) div r.each")).alias("pack_id"), (F.col("r.place0") + offset % F.col("r.each")).cast("int").alias("place"), "doc_id", "piece", "begin", "length")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
