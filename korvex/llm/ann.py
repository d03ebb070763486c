"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a vector to the slots of a few Gaussian
projections, floor((a . x + b) / w); equal slots are a bucket. The number of
projections grows with the logarithm of the number of vectors, so that the
directory of occupied buckets grows with its root; buckets that are next to
each other in the directory share a shard, whose size grows with the root too
(ROOTS times it, SHARD vectors at least), and so does the number of shards.

Buckets around a query are enumerated by a heap over the perturbations of its
slots, in the order of their estimated chance to hold a neighbour. A pilot
visits buckets of the first table until they have PILOT vectors for each
neighbour that is asked for, which bounds the distance of the k-th. At that
distance the projections of a neighbour spread normally around the query's own,
which gives the chances: buckets are visited until all tables miss a neighbour
with a chance of 1 - RECALL. Only vectors within the bound leave a shard, where
they get exact distances; the tables' candidates are merged and the k nearest
stay. The visits adapt to the query: few in clusters, up to all buckets where
all distances are alike, so no cap drops a candidate, and they are made in the
same way for any number of vectors.

Defined results: rows with a null id or a vector that is null, empty, has a
null or a number that isn't finite, or another length than most have (the
largest one of ties) are ignored; of rows that repeat an id the smallest vector
counts; a vector is no neighbour of its own id, but others that equal it are;
ties go to the smaller id; with fewer than k others there are fewer rows; ids
may have any type that sorts; other columns may have any names; no rows in give
no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.llm.ids import dtype, named, numbered
from korvex.plans.util import fresh, quoted, spread, table, written

K = 10
TABLES = 2
RECALL = 0.97
#: Vectors of a shard, at least, and as a multiple of the root of their number; queries that are compared with it at once.
SHARD, ROOTS, BLOCK = 4096, 16, 512
#: Vectors that the pilot compares for each neighbour that is asked for, at least.
PILOT = 32
#: A slot's width in standard deviations of the projections, and the farthest slot's number.
WIDTH, FARTHEST = 2.0, 5


class Hasher:
    """The projections of all tables for vectors of one dimension."""

    def __init__(self, dimension: int, n: int, mean: np.ndarray, spread: float, tables: int = TABLES, seed: int = 3):
        self.functions = max(2, round(math.log2(max(n, 4)) / 2 / 1.3))
        rng = np.random.default_rng(seed)
        a = rng.standard_normal((tables, self.functions, dimension))
        self.a = a / np.linalg.norm(a, axis=2, keepdims=True) * math.sqrt(dimension)
        self.width = WIDTH * (spread or 1.0) * math.sqrt(dimension)
        self.b = rng.random((tables, self.functions)) * self.width - self.a @ mean
        self.tables = tables

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        """[rows, functions] positions in units of slots."""
        return (x.astype(np.float64) @ self.a[t].T + self.b[t]) / self.width

    def codes(self, x: np.ndarray, t: int) -> np.ndarray:
        slots = np.clip(np.floor(self.places(x, t)), -FARTHEST, FARTHEST).astype(np.int64) + FARTHEST
        return slots @ (2 * FARTHEST + 1) ** np.arange(self.functions, dtype=np.int64)

    def slots(self, codes: np.ndarray) -> np.ndarray:
        """[buckets, functions] slots of codes, from 0."""
        return codes[:, None] // (2 * FARTHEST + 1) ** np.arange(self.functions, dtype=np.int64) % (2 * FARTHEST + 1)


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    z = np.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


class Directory:
    """The occupied buckets of each table, how many vectors they have, and the shards that hold them."""

    def __init__(self, hasher: Hasher, counts: list[tuple[int, int, int]], shard: int):
        self.hasher = hasher
        self.codes, self.size, self.shard, self.pieces, self.local, self.width = [], [], [], {}, [], {}
        key = 0
        for t in range(hasher.tables):
            own = sorted((c, n) for u, c, n in counts if u == t)
            shards, local = [], []
            held, first = 0, 0
            for k, (_, n) in enumerate(own):
                if held and held + n > shard:
                    key, held, first = key + 1, 0, k
                shards.append(key)
                local.append(k - first)
                held += n
                self.pieces[key] = max(1, -(-held // (2 * shard)))
                self.width[key] = k - first + 1
            key += 1
            self.codes.append(np.array([c for c, _ in own], np.int64))
            self.size.append([n for _, n in own])
            self.shard.append(np.array(shards, np.int64))
            self.local.append(np.array(local, np.int64))
        self.steps = np.array([self.pieces.get(k, 1) for k in range(key)], np.int64)
        self._place: list[dict[int, int]] = []

    def home(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket (its place in the directory) and the shard of each vector."""
        at = np.searchsorted(self.codes[t], self.hasher.codes(x, t))
        return at, self.shard[t][at]

    def piece(self, ids: np.ndarray, shard: np.ndarray | int) -> np.ndarray:
        """Which piece of its shard a vector lies in: shards of one very large bucket have several."""
        return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)) % self.steps[shard]

    def perturbed(self, x: np.ndarray, radius: np.ndarray, t: int) -> Iterator[Iterator[tuple[float, int]]]:
        """For each vector: (chance, code) of the buckets around it, the likeliest to hold a neighbour at radius first."""
        h = self.hasher
        edge = np.arange(-FARTHEST, FARTHEST + 2, dtype=np.float64)
        edge[0], edge[-1] = -1e9, 1e9
        sigma = np.maximum(np.where(np.isfinite(radius), radius, h.width), 1e-9 * h.width) / h.width
        below = _phi(np.clip((edge[None, None] - h.places(x, t)[:, :, None]) / sigma[:, None, None], -40, 40))
        inside = np.maximum(np.diff(below, axis=2), 0)
        order = np.argsort(-inside, axis=2, kind="stable")
        chance = np.take_along_axis(inside, order, axis=2)
        step = (2 * FARTHEST + 1) ** np.arange(h.functions, dtype=np.int64)
        code = order * step[None, :, None]
        for c, s in zip(chance.tolist(), code.tolist()):
            yield best_first(c, s)

    def visits(self, x: np.ndarray, radius: np.ndarray, t: int, miss: float = 0.0, enough: int | None = None) -> list[list[int]]:
        """Occupied buckets to visit, in order: until the others hold a neighbour at radius with a chance of at most miss, or those visited have enough vectors."""
        if not self._place:
            self._place = [{int(c): k for k, c in enumerate(codes)} for codes in self.codes]
        place, size, out = self._place[t], self.size[t], []
        for row, r in zip(self.perturbed(x, radius, t), radius):
            own, seen, held = [], 0.0, 0
            if enough is None and not np.isfinite(r):  # fewer vectors than neighbours asked for
                out.append(list(range(len(size))))
                continue
            for chance, code in row:
                at = place.get(code)
                if at is not None:
                    own.append(at)
                    held += size[at]
                seen += chance
                if held >= enough if enough is not None else seen >= 1 - miss:
                    break
            out.append(own)
        return out


def best_first(chance: list[list[float]], code: list[list[int]]) -> Iterator[tuple[float, int]]:
    """(product, sum) of one entry of each row of chance and code, the largest product first; rows fall, and each combination comes once.

    A heap of combinations: one that was taken is followed by those that step
    to the next entry in its last changed row or in a later one. Combinations
    with no chance are left out.
    """
    rows = len(chance)
    first = math.prod(c[0] for c in chance)
    heap = [(-first, (0,) * rows, 0, sum(c[0] for c in code))]
    while heap:
        minus, at, last, total = heapq.heappop(heap)
        yield -minus, total
        for j in range(last, rows):
            k = at[j]
            row = chance[j]
            if k + 1 < len(row) and row[k + 1] > 1e-12:
                heapq.heappush(heap, (minus / row[k] * row[k + 1], (*at[:j], k + 1, *at[j + 1 :]), j, total - code[j][k] + code[j][k + 1]))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    values = column.flatten()
    return np.asarray(values.to_numpy(zero_copy_only=False), np.float32).reshape(-1, dimension)


def _pack(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _unpack(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def _augmented(x: np.ndarray) -> tuple[np.ndarray, float]:
    """x with its squared lengths and ones, so that one matrix product gives squared distances; the largest squared length."""
    squares = (x * x).sum(axis=1)
    return np.hstack([x, squares[:, None], np.ones((len(x), 1), np.float32)]), float(squares.max(initial=0))


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray | None = None, allowed: np.ndarray | None = None, augmented: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, distance) of the k nearest allowed rows of x within bound of each q; exact distances, ties to the smaller id."""
    wide, most = augmented or _augmented(x)
    qs = (q * q).sum(axis=1)
    d = np.hstack([-2 * q, np.ones((len(q), 1), np.float32), qs[:, None]]) @ wide.T
    slack = 2e-5 * (qs + most)  # the product's rounding; what is kept is compared exactly below
    limit = np.full(len(q), np.inf) if bound is None else bound**2
    if not np.isfinite(limit).all() and d.shape[1] > k:
        if allowed is not None:
            d[~allowed] = np.inf
        # One more than k, as a vector may lie among its own neighbours.
        limit = np.minimum(limit, np.partition(d, k, axis=1)[:, k])
    near = d <= (limit + slack).astype(np.float32)[:, None]
    if allowed is not None:
        near &= allowed
    row, col = np.nonzero(near)
    other = q_ids[row] != ids[col]
    row, col = row[other], col[other]
    exact = np.sqrt(((q[row].astype(np.float64) - x[col]) ** 2).sum(axis=1))
    if bound is not None:
        inside = exact <= bound[row]
        row, col, exact = row[inside], col[inside], exact[inside]
    order = np.lexsort((ids[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    top = place < k
    return row[top], ids[col[top]], exact[top]


def _moments(dimension: int):
    """Sums of each component, then the number of vectors and the sum of their squares: (at, total) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimension + 2)
        for batch in batches:
            x = _matrix(batch.column(0), dimension).astype(np.float64)
            total += np.concatenate([x.sum(axis=0), [len(x), (x * x).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension + 2, dtype=np.int32)), pa.array(total)], ["at", "total"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Sorted batches cut where their first columns change, one piece at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for i, j in zip([0, *change], [*change, batch.num_rows]):
            yield tuple(int(c[i]) for c in cols), batch.slice(i, j - i)


_SHARDED = "shard bigint, piece bigint, kind int, bucket bigint, id bigint, vec binary, bound double, visits binary"
_NAMES = [c.split()[0] for c in _SHARDED.split(", ")]


def _index(directory: Directory, dimension: int, tables: int):
    """Vectors (id, vec) to the rows (kind 0) of their shards in the first tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dimension)
            packed = _pack(x)
            for t in range(tables):
                bucket, shard = directory.home(x, t)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(directory.piece(ids, shard)), pa.array(np.zeros(n, np.int32)), pa.array(directory.local[t][bucket]), pa.array(ids), packed, pa.nulls(n, pa.float64()), pa.nulls(n, pa.binary())], _NAMES)

    return run


def _asked(directory: Directory, dimension: int, miss: float, enough: int, pilot: bool):
    """Queries (id, vec, bound) to rows (kind 1) of the shards that they visit, with the buckets.

    pilot: the buckets of the first table until they have enough vectors;
    otherwise those of all tables that the chance asks for, without the former.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dimension)
                bound = batch.column(2).to_numpy(zero_copy_only=False)
                packed = _pack(x)
                first = directory.visits(x, np.full(len(ids), np.inf), 0, enough=enough)
                for t in range(1 if pilot else directory.hasher.tables):
                    own = first if pilot else directory.visits(x, bound, t, miss)
                    out: list[tuple] = []
                    for r, places in enumerate(own):
                        if not pilot and t == 0:
                            places = np.setdiff1d(places, first[r])
                        places = np.sort(np.asarray(places, np.int64))
                        shards = directory.shard[t][places]
                        for s in np.unique(shards):
                            bits = np.zeros(directory.width[int(s)], np.uint8)
                            bits[directory.local[t][places[shards == s]]] = 1
                            mask = np.packbits(bits).tobytes()
                            out += [(int(s), piece, r, int(places[0]), mask) for piece in range(int(directory.steps[s]))]
                    if out:
                        s, piece, r, bucket, mask = zip(*out)
                        rows, n = np.array(r), len(out)
                        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(piece, pa.int64()), pa.array(np.ones(n, np.int32)), pa.array(bucket, pa.int64()), pa.array(ids[rows]), packed.take(pa.array(rows)), pa.array(bound[rows]), pa.array(mask, pa.binary())], _NAMES)

    return run


def _probe(k: int):
    """Sorted rows of shards to candidates (id, near, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, x = None, [], None
        for (shard, piece, kind), part in _grouped(batches, 3):
            if (shard, piece) != key:
                key, held, x = (shard, piece), [], None
            if kind == 0:
                held.append(part)
                continue
            if not held:
                continue
            if x is None:
                bucket = np.concatenate([p.column(3).to_numpy() for p in held])
                ids = np.concatenate([p.column(4).to_numpy() for p in held])
                x = np.concatenate([_unpack(p.column(5)) for p in held])
                wide, most = _augmented(x)
            for at in range(0, part.num_rows, BLOCK):
                own = part.slice(at, BLOCK)
                q_ids, q, bound = own.column(4).to_numpy(), _unpack(own.column(5)), own.column(6).to_numpy()
                bits = own.column(7).to_pylist()
                visits = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(bool)
                visits = visits[:, : int(bucket.max()) + 1]
                seen = visits.any(axis=0)[bucket]
                if seen.all():
                    row, near, d = nearest(q, q_ids, x, ids, k, bound, visits[:, bucket], (wide, most))
                elif seen.any():
                    cols = np.flatnonzero(seen)
                    row, near, d = nearest(q, q_ids, x[cols], ids[cols], k, bound, visits[:, bucket[cols]], (wide[cols], most))
                if seen.any():
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(near), pa.array(d)], ["id", "near", "distance"])

    return run


def neighbours(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", asked: Column | None = None, tables: int = TABLES, recall: float = RECALL, shard: int | None = None) -> DataFrame:
    """(vec_id, neighbour_id, distance, rank): among all vectors the k nearest of those that are asked for (a condition on vectors; None: of every one)."""
    name = fresh(vectors, "kx_n")
    rows, known = numbered(vectors, id_col, name)
    rows = rows.select(F.col(name).alias("id"), quoted(vec_col).cast("array<float>").alias("vec"), (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("asked"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(~bad)
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        kind = dtype(vectors, id_col)
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, neighbour_id {kind}, distance double, rank bigint")
    dimension = most.d
    rows = written(rows.where(F.size("vec") == dimension).groupBy("id").agg(F.min("vec").alias("vec"), F.bool_or("asked").alias("asked")))
    # Over all vectors: their number, mean, and spread around it.
    totals = dict(tuple(r) for r in rows.select("vec").mapInArrow(_moments(dimension), "at int, total double").groupBy("at").agg(F.sum("total")).collect())
    n, squares = int(totals[dimension]), totals[dimension + 1]
    mean = np.array([totals[c] for c in range(dimension)]) / n
    hasher = Hasher(dimension, n, mean, math.sqrt(max(0.0, (squares / n - float(mean @ mean)) / dimension)), tables)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dimension)
            for t in range(tables):
                codes, counts = np.unique(hasher.codes(x, t), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t)), pa.array(codes), pa.array(counts.astype(np.int64))], ["t", "code", "n"])

    counts = rows.select("vec").mapInArrow(hashed, "t bigint, code bigint, n bigint").groupBy("t", "code").agg(F.sum("n").alias("n"))
    shard = shard or max(SHARD, int(ROOTS * math.sqrt(n)))
    directory = Directory(hasher, [tuple(r) for r in counts.collect()], shard)  # the root of n rows, about
    keys = int(directory.steps.sum())
    enough, miss = PILOT * k, (1 - recall) ** (1 / tables)

    def probed(queries: DataFrame, pilot: bool) -> DataFrame:
        """Candidates (id, near, distance) of queries (id, vec, bound)."""
        sharded = rows.select("id", "vec").mapInArrow(_index(directory, dimension, 1 if pilot else tables), _SHARDED)
        sharded = sharded.unionByName(spread(queries.select("id", "vec", "bound")).mapInArrow(_asked(directory, dimension, miss, enough, pilot), _SHARDED))
        # A shard is one task's work; a number of partitions that is given isn't changed by Spark.
        sharded = sharded.repartition(max(1, keys // tables if pilot else keys), "shard", "piece").sortWithinPartitions("shard", "piece", "kind", "bucket")
        return sharded.mapInArrow(_probe(k), "id bigint, near bigint, distance double")

    def best(found: DataFrame) -> DataFrame:
        return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "near"))), 1, k).alias("best"))

    queries = rows.where("asked")
    early = written(best(probed(queries.withColumn("bound", F.lit(float("inf"))), True)))
    bound = early.where(F.size("best") == k).select("id", F.element_at("best", -1)["distance"].alias("bound"))
    bounded = written(queries.join(bound, "id", "left").select("id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound")))
    found = early.select("id", F.explode("best").alias("b")).select("id", F.col("b.near").alias("near"), F.col("b.distance").alias("distance"))
    # The k nearest distinct ones; a candidate of several tables has one distance.
    out = best(found.unionByName(probed(bounded, False))).select("id", F.posexplode("best").alias("at", "b"))
    out = out.select(F.col("id").alias("vec_id"), F.col("b.near").alias("neighbour_id"), F.round("b.distance", 6).alias("distance"), (F.col("at") + 1).cast("bigint").alias("rank"))
    return named(out, known, ["vec_id", "neighbour_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose number can be divided by 50, against all vectors."""
    return neighbours(table(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % 50 == 0)
