"""Exact dedup with counting quotient filters.

Every input partition builds counting quotient filters over its texts' 64-bit
fingerprints, one for each range of fingerprints. The filters of a range merge
without loss by walking their sorted remainders; a fingerprint whose merged
count is above one sends its documents on to a comparison of the texts' bytes,
so a fingerprint collision never drops a document.

Defined results: null texts are never duplicates; empty texts equal each other;
rows that repeat count as copies; of a group, the row with the smallest id (ids
that are null last, equal ones by a hash of the row) stays; ids of any type
that sorts; other columns may have any names and types, maps too; no rows in
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.plans.util import all_columns, cut, fresh, join_checked, quoted, row_hash, table


#: Fingerprints of a range, about.
SHARD = 1 << 21


class CountingQuotientFilter:
    """Sorted 64-bit fingerprints with counts, kept as quotient and remainder.

    A fingerprint's high ``q`` bits name its home slot and its low bits are
    stored. Runs of one home slot lie in order and may be shifted right; the
    two bit vectors ``occupied`` (a run exists for this home slot) and
    ``runend`` (a run ends in this slot) recover every quotient, so the filter
    decodes to exactly what was put in.
    """

    def __init__(self, q: int, base: int, bits: int, occupied: np.ndarray, used: np.ndarray, runend: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.base, self.bits = q, base, bits
        self.occupied, self.used, self.runend = occupied, used, runend
        self.remainders, self.counts = remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, base: int = 0, bits: int = 64) -> CountingQuotientFilter:
        """Of fingerprints whose top 64 - bits bits all equal base."""
        if counts is None:
            keys, counts = np.unique(fingerprints, return_counts=True)
        else:
            keys = fingerprints
        q = min(bits - 1, max(1, int(np.ceil(np.log2(max(len(keys), 1)))) + 1))
        local = keys if bits == 64 else keys & np.uint64((1 << bits) - 1)
        r = np.uint64(bits - q)
        home = (local >> r).astype(np.int64)
        remainders = local & np.uint64((1 << int(r)) - 1)
        order = np.arange(len(keys))
        slot = np.maximum.accumulate(home - order) + order if len(keys) else home
        n = max(1 << q, int(slot[-1]) + 1 if len(keys) else 0)
        occupied, used, runend = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        occupied[home], used[slot] = True, True
        if len(keys):
            runend[slot[np.append(home[1:] != home[:-1], True)]] = True
        return cls(q, base, bits, occupied, used, runend, remainders, counts.astype(np.uint32))

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order, and their counts."""
        if not len(self.remainders):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        ends = self.runend[self.used]
        run = np.concatenate(([0], np.cumsum(ends)[:-1]))
        home = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        local = (home << np.uint64(self.bits - self.q)) | self.remainders
        if self.bits < 64:
            local = local | np.uint64(self.base << self.bits)
        return local, self.counts

    def count(self, fingerprint: int) -> int:
        """How often fingerprint was put in: rank of its home slot, then its run."""
        if self.bits < 64 and fingerprint >> self.bits != self.base:
            return 0
        local = fingerprint & ((1 << self.bits) - 1)
        home, remainder = local >> (self.bits - self.q), local & ((1 << (self.bits - self.q)) - 1)
        if not self.occupied[home]:
            return 0
        rank = int(self.occupied[: home + 1].sum())
        ends = np.flatnonzero(self.runend[self.used])
        begin = int(ends[rank - 2]) + 1 if rank > 1 else 0
        run = self.remainders[begin : int(ends[rank - 1]) + 1]
        k = int(np.searchsorted(run, np.uint64(remainder)))
        return int(self.counts[begin + k]) if k < len(run) and int(run[k]) == remainder else 0

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both inputs: equal remainders of a run add their counts."""
        (a, ca), (b, cb) = self.decode(), other.decode()
        keys = np.concatenate((a, b))
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        keys, counts = keys[order], np.concatenate((ca, cb))[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts.astype(np.uint64), first) if len(keys) else counts
        return CountingQuotientFilter.build(keys[first], sums, self.base, self.bits)

    def to_bytes(self) -> bytes:
        width = (self.bits - self.q + 7) // 8
        head = np.array([self.q, self.bits, self.base, len(self.used), len(self.remainders)], np.int64).tobytes()
        bits = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.used, self.runend))
        packed = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
        small = np.minimum(self.counts, 255).astype(np.uint8)
        return head + bits + packed + small.tobytes() + self.counts[self.counts >= 255].astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, bits, base, slots, n = (int(x) for x in np.frombuffer(data, np.int64, 5))
        at, each = 40, (slots + 7) // 8
        vectors = []
        for _ in range(3):
            vectors.append(np.unpackbits(np.frombuffer(data, np.uint8, each, at), count=slots).astype(bool))
            at += each
        width = (bits - q + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.uint32)
        counts[counts == 255] = np.frombuffer(data, "<u4", int((counts == 255).sum()), at + n)
        return cls(q, base, bits, *vectors, wide.reshape(-1).view("<u8").astype(np.uint64), counts)


def _build(shard_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not parts:
            return
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        shards = (keys >> np.uint64(64 - shard_bits)).astype(np.int64)
        cuts = np.searchsorted(shards, np.arange((1 << shard_bits) + 1))
        rows = [(s, CountingQuotientFilter.build(keys[i:j], counts[i:j], s, 64 - shard_bits).to_bytes()) for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "filter"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filters to fingerprints with a count above one; merges like-sized filters, so each element moves log(filters) times."""
    stacks: dict[int, list[CountingQuotientFilter]] = {}
    for batch in batches:
        for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            stack = stacks.setdefault(shard, [])
            stack.append(CountingQuotientFilter.from_bytes(data))
            while len(stack) > 1 and len(stack[-2].remainders) <= 2 * len(stack[-1].remainders):
                top = stack.pop()
                stack[-1] = stack[-1].merge(top)
    for stack in stacks.values():
        while len(stack) > 1:
            top = stack.pop()
            stack[-1] = stack[-1].merge(top)
        keys, counts = stack[0].decode()
        yield pa.RecordBatch.from_arrays([pa.array(keys[counts > 1].view(np.int64), pa.int64())], ["fp"])


def repeated_fingerprints(docs: DataFrame, text_col: str = "text", hash_col=None) -> DataFrame:
    """(fp): fingerprints that more than one non-null text of docs has."""
    # As many ranges as keep a merged filter at SHARD fingerprints, about; the count reads no text.
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // SHARD))
    bits = max(1, int(np.ceil(np.log2(max(2, shards)))))
    fp = F.xxhash64(F.col(text_col)) if hash_col is None else hash_col
    keys = docs.where(F.col(text_col).isNotNull()).select(fp.alias("fp"))
    filters = keys.mapInArrow(_build(bits), "shard int, filter binary")
    return filters.repartition(shards, "shard").mapInArrow(_merge, "fp bigint")


def _candidates(docs: DataFrame, text_col: str, hash_col=None) -> tuple[DataFrame, str]:
    """docs with a column that holds the repeated fingerprint, null where the text is certainly unique."""
    name, hit = fresh(docs, "kx_fp"), fresh(docs, "kx_hit")
    repeated = cut(repeated_fingerprints(docs, text_col, hash_col).withColumnRenamed("fp", name).withColumn(hit, F.lit(True)))
    keyed = docs.withColumn(name, F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col)) if hash_col is None else hash_col))
    out = join_checked(keyed, repeated, [name], "left", 32)
    return out.withColumn(name, F.when(F.col(hit), F.col(name))).select(*all_columns(docs), name), name


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_col=None) -> DataFrame:
    """(doc_id, group_id) of every document whose text another row has too; group_id is the smallest id of the group."""
    docs = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    flagged, fp = _candidates(docs, "text", hash_col)
    flagged = flagged.where(F.col(fp).isNotNull())
    # Bytes are compared here: the group key is the text itself, of which each task sends one copy on.
    texts = flagged.groupBy(fp, "text").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    verified = cut(texts.groupBy(fp).agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.min("group_id").alias("group_id")))
    # Where all texts of a fingerprint are one, the fingerprint tells the group, however large.
    keyed = docs.where("text IS NOT NULL").select("doc_id", (F.xxhash64("text") if hash_col is None else hash_col).alias(fp))
    out = join_checked(keyed, verified.where("texts = 1 AND n > 1").select(fp, "group_id"), [fp], "inner", 32).select("doc_id", "group_id")
    several = verified.where("texts > 1").select(fp)
    if several.limit(1).count():
        rest = join_checked(flagged, several, [fp], "left_semi", 24)
        own = rest.groupBy(fp, "text").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(rest.join(own, [fp, "text"]).select("doc_id", "group_id"))
    return out


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_col=None) -> DataFrame:
    """docs without the later copies of each text; all columns and all rows with a null text stay."""
    flagged, fp = _candidates(docs, text_col, hash_col)
    unique = flagged.where(F.col(fp).isNull()).select(*all_columns(docs))
    order = F.struct(quoted(id_col).isNull().alias("n"), quoted(id_col).alias("i"), row_hash(docs).alias("h"))
    first = F.min_by(F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]), order)
    copies = flagged.where(F.col(fp).isNotNull()).groupBy(fp, text_col).agg(first.alias("kx_first"))
    kept = copies.select(*[F.col(f"kx_first.c{k}").alias(c) for k, c in enumerate(docs.columns)])
    return unique.unionByName(kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, group_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS n
  FROM documents WHERE text IS NOT NULL)
WHERE n > 1
"""
