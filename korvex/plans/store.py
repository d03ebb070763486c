"""Immutable generations of Parquet tables behind a numbered manifest.

A writer writes new files for what it changes and then creates the next
manifest, which fails if another writer created it first; readers pin one
manifest and see one state. All file operations go through Hadoop's file
system, so that the folder may lie on any storage that Spark knows.

Tables of documents are kept in buckets by a hash of the document, so that a
commit rewrites the buckets of the documents that it changes and no others. The
keyword index is kept in segments: a commit adds one with the postings that came
(sign 1) and went (sign -1), in buckets by a hash of the term; segments of like
sizes are merged, so that a posting is rewritten as often as the logarithm of
the number of commits, and a search reads the buckets of its terms.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from korvex.plans.util import small

SCHEMAS = {
    "documents": "document_id string, type string, title string, source_id string, source_uri string, cluster_id string, content_type string, content_hash string, version bigint, size bigint, created_at double, modified_at double, ingested_at double, is_deleted boolean",
    "versions": "version_id string, document_id string, content_hash string, created_at double",
    "representations": "representation_id string, lineage_id string, document_id string, kind string, text string",
    "chunks": "chunk_id string, document_id string, lineage_id string, policy_id string, ordinal bigint, text string, content_hash string, character_start bigint, character_end bigint, byte_start bigint, byte_end bigint, token_start bigint, token_end bigint, line_start bigint, line_end bigint, context_before string, context_after string, occurrence bigint, modality string, active boolean, created_at double",
    "embeddings": "embedding_id string, chunk_id string, document_id string, embedding_space_id string, model_id string, dimension bigint, modality string, prompt_kind string, backend string, embedding array<float>, created_at double",
    "jobs": "id string, kind string, state string, message string, started_at double, finished_at double, updated_at double",
    "failures": "id string, document_id string, source_uri string, category string, message string, occurred_at double",
    "policies": "policy_id string, version bigint, required array<string>, status string, missing array<string>",
    "file_state": "source_id string, document_id string, fingerprint string",
    "cursors": "namespace string, key string, value string",
    "migrations": "version int, applied_at double",
}
POSTINGS = "term string, chunk_id string, tf bigint, length bigint, sign bigint"
#: Tables in buckets of documents; the number of buckets of a new store, and of the terms' buckets of a segment.
KEYED = ("documents", "versions", "representations", "chunks", "embeddings")
BUCKETS, TERM_BUCKETS = 32, 32
SCHEMA_VERSION = 6


class Conflict(Exception):
    """Another writer committed first."""


class NewerStore(RuntimeError):
    """The store was written by a newer version."""


def bucket_of(column: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


class Corpus:
    """One index's tables at one generation."""

    def __init__(self, spark: SparkSession, root: str, generation: int | None = None, buckets: int = BUCKETS, term_buckets: int = TERM_BUCKETS):
        """buckets, term_buckets: of a new store; as many as keep a bucket at what one task rewrites."""
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root + "/manifest").getFileSystem(spark._jsc.hadoopConfiguration())
        self.generation = self._last() if generation is None else generation
        self.state: dict = {"tables": {}, "buckets": buckets, "term_buckets": term_buckets, "segments": [], "index": {"chunks": 0, "length": 0, "stem": None}}
        if self.generation:
            self.state |= self._read(self.generation)
        else:
            self.commit({"migrations": spark.createDataFrame([(v, 0.0) for v in range(1, SCHEMA_VERSION + 1)], SCHEMAS["migrations"])})

    @property
    def tables(self) -> dict:
        return self.state["tables"]

    @property
    def index(self) -> dict:
        """Of the keyword index: chunks, their terms in all, and whether terms are stems (None: there is no index yet)."""
        return self.state["index"]

    def _names(self, path: str) -> list[str]:
        folder = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _last(self) -> int:
        return max((int(n[:-5]) for n in self._names(self.root + "/manifest") if n.endswith(".json") and n[0] != "."), default=0)

    def _manifest(self, generation: int) -> str:
        return f"{self.root}/manifest/{generation:012d}.json"

    def _read(self, generation: int) -> dict:
        for wait in (0.05, 0.2, 1.0, 3.0):
            stream = self._fs.open(self._path(self._manifest(generation)))
            try:
                data = json.loads(bytes(stream.readAllBytes()))
                break
            except ValueError:  # its writer is not done
                time.sleep(wait)
            finally:
                stream.close()
        if data["schema_version"] > SCHEMA_VERSION:
            raise NewerStore(f"schema version {data['schema_version']}")
        return {k: v for k, v in data.items() if k != "schema_version"}

    def _files(self, paths: list[str], schema: str) -> DataFrame:
        kind = StructType.fromDDL(schema)
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or the buckets of it."""
        at = self.tables.get(name)
        if isinstance(at, dict):
            return self._files([p for b, p in sorted(at.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets], SCHEMAS[name])
        rows = self._files([at] if at else [], SCHEMAS[name])
        if buckets is not None and name in KEYED:  # a store of an older version
            rows = rows.where(bucket_of(F.col("document_id"), self.state["buckets"]).isin(sorted(buckets)))
        return rows

    def buckets(self, *ids: DataFrame) -> set[int]:
        """The buckets that have the documents of the frames."""
        n, out = self.state["buckets"], set()
        for df in ids:
            out |= {r.b for r in df.select(bucket_of(F.col("document_id"), n).alias("b")).distinct().collect()}
        return out

    def _store(self, name: str, df: DataFrame, schema: str, bucket: Column | None) -> str | dict[str, str]:
        """Writes a table; in buckets, their paths."""
        path = f"data/{name}-{uuid.uuid4().hex}"
        df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields])
        if bucket is None:
            df.write.option("compression", "zstd").parquet(f"{self.root}/{path}")
            return path
        # Rebalancing splits what is too large for one task, such as the postings of a frequent term.
        df = df.withColumn("_bucket", bucket).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *([c for c in ("term", "document_id") if c in df.columns]))
        df.write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.root}/{path}")
        return {n.removeprefix("_bucket="): f"{path}/{n}" for n in self._names(f"{self.root}/{path}") if n.startswith("_bucket=")}

    def commit(self, tables: dict[str, DataFrame], buckets: set[int] | None = None, postings: DataFrame | None = None, index: dict | None = None) -> Corpus:
        """Writes the tables and moves to the next generation.

        buckets: those that the tables of documents stand for, other buckets
        stay; None: the tables are whole. postings: a segment to add, with a row
        for a term and chunk (see fold()); index: what the index has with it.
        """
        new = json.loads(json.dumps(self.state))

        def table(name: str, df: DataFrame) -> str | dict[str, str]:
            if name not in KEYED:
                return self._store(name, df, SCHEMAS[name], None)
            old, touched, key = new["tables"].get(name, {}), buckets, bucket_of(F.col("document_id"), new["buckets"])
            if touched is not None and not isinstance(old, dict):  # a table of an older version
                df, touched = df.unionByName(self.read(name).where(~key.isin(sorted(touched)))), None
            stored = self._store(name, df, SCHEMAS[name], key)
            return stored if touched is None else {b: p for b, p in old.items() if int(b) not in touched} | stored

        # The tables are written side by side, as most are small.
        with ThreadPoolExecutor(8) as pool:
            jobs = {name: pool.submit(table, name, df) for name, df in tables.items()}
            segment = None if postings is None else pool.submit(self._segment, postings)
            stored = {name: job.result() for name, job in jobs.items()}
            if segment is not None:
                new["segments"] = self._merged([*new["segments"], segment.result()])
        new["tables"] |= stored
        if index is not None:
            new["index"] = index
        self._create(self._manifest(self.generation + 1), json.dumps({"schema_version": SCHEMA_VERSION} | new))
        self.generation += 1
        self.state = new
        return self

    def _create(self, path: str, text: str) -> None:
        """Writes a file that mustn't be there yet: where two writers try, one of them wins."""
        where = self._path(path)
        if self._fs.getUri().getScheme() == "file":
            name = where.toUri().getPath()
            os.makedirs(os.path.dirname(name), exist_ok=True)
            draft = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
            with open(draft, "w") as f:
                f.write(text)
            try:
                os.link(draft, name)
            except FileExistsError as e:
                raise Conflict(path) from e
            finally:
                os.remove(draft)
            return
        try:  # an exclusive create is atomic where the storage offers it; a rename after a look isn't
            stream = self._fs.create(where, False)
        except Py4JJavaError as e:
            raise Conflict(path) from e
        stream.write(bytearray(text.encode()))
        stream.close()

    # Keyword index

    def _segment(self, postings: DataFrame) -> dict:
        stored = self._store("postings", postings, POSTINGS, bucket_of(F.col("term"), self.state["term_buckets"]))
        rows = self._files(list(stored.values()), POSTINGS).count()
        return {"rows": rows, "buckets": stored}

    def _merged(self, segments: list[dict]) -> list[dict]:
        """segments, the last of which are merged while they are of like sizes; the first one has no postings that went."""
        segments = [s for s in segments if s["rows"]]
        while len(segments) > 1 and segments[-2]["rows"] <= 2 * segments[-1]["rows"]:
            both = fold(self._files([p for s in segments[-2:] for p in s["buckets"].values()], POSTINGS))
            segments = [s for s in [*segments[:-2], self._segment(both)] if s["rows"]]
        return segments

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, chunk_id, tf, length) of the index; only the buckets of terms (term) are read."""
        own = None if terms is None else {str(r.b) for r in terms.select(bucket_of(F.col("term"), self.state["term_buckets"]).alias("b")).distinct().collect()}
        paths = [p for s in self.state["segments"] for b, p in s["buckets"].items() if own is None or b in own]
        rows = self._files(paths, POSTINGS)
        if terms is not None:
            rows = rows.join(small(terms.select("term").distinct()), "term", "left_semi")
        return (rows if len(self.state["segments"]) == 1 else fold(rows)).drop("sign")

    def refresh(self) -> Corpus:
        self.generation = self._last()
        self.state |= self._read(self.generation)
        return self

    @staticmethod
    def _used(state: dict) -> set[str]:
        paths = [p for at in state["tables"].values() for p in (at.values() if isinstance(at, dict) else [at])]
        return {p.split("/")[1] for p in [*paths, *(p for s in state.get("segments", []) for p in s["buckets"].values())]}

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what only generations before the last keep ones use."""
        used = set().union(*(self._used(self._read(g)) for g in range(max(1, self.generation - keep + 1), self.generation + 1)))
        for name in self._names(self.root + "/data"):
            if name not in used:
                self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
        for g in range(1, self.generation - keep + 1):
            self._fs.delete(self._path(self._manifest(g)), False)

    def byte_size(self) -> int:
        return sum(self._fs.getContentSummary(self._path(f"{self.root}/data/{n}")).getLength() for n in self._used(self.state))

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)


def fold(postings: DataFrame) -> DataFrame:
    """Postings that came and went, added up; what is left has a sign."""
    own = postings.groupBy("term", "chunk_id").agg(F.max("tf").alias("tf"), F.max("length").alias("length"), F.sum("sign").alias("sign"))
    return own.where("sign <> 0")
