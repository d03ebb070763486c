"""The local-file connector: scan, payloads, change detection, cursors, retries."""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.functions.text import content_type_of, fnv1a_hex, is_text_like, representation_kind, stable_hash

MAX_BYTES = 20 * 1024 * 1024
#: Folders that count as one package and aren't entered.
PACKAGES = (".app", ".bundle", ".framework", ".photoslibrary", ".rtfd", ".pages", ".key", ".numbers", ".xcodeproj")
SCAN = "document_id string, relative_path string, source_uri string, display_name string, path_extension string, size bigint, modified_at double, changed_at double"


class SourceUnavailable(RuntimeError):
    """A first scan that couldn't read everything, or a root that is gone."""


class InvalidCursor(ValueError):
    """A cursor of another source or version."""


@dataclass(frozen=True)
class LocalFiles:
    """A folder (or one file) as a source."""

    root: str
    connector_id: str = "local"
    extensions: tuple[str, ...] | None = None
    include_hidden: bool = False
    max_bytes: int = MAX_BYTES

    def walk(self, should_stop=lambda: False) -> tuple[list[tuple], list[tuple[str, str]]]:
        """Rows of SCAN in id order, and (relative path, reason) of what couldn't be read. Only names and sizes are read here."""
        root = os.path.abspath(self.root)
        allowed = None if self.extensions is None else {e.lower().lstrip(".") for e in self.extensions}
        if not os.path.exists(root):
            raise SourceUnavailable(root)
        rows, unreadable = [], []

        def add(path: str, name: str) -> None:
            ext = os.path.splitext(path)[1].lower().lstrip(".")
            if allowed is not None and ext not in allowed:
                return
            try:
                st = os.stat(path, follow_symlinks=False)
            except OSError as e:
                unreadable.append((name, str(e)))
                return
            if os.path.isfile(path) and not os.path.islink(path) and st.st_size <= self.max_bytes:
                rows.append((f"{self.connector_id}:{name}", name, "file://" + path, os.path.basename(path), ext, st.st_size, st.st_mtime, st.st_ctime))

        if os.path.isfile(root):
            add(root, os.path.basename(root))
            return rows, unreadable

        def failed(e: OSError) -> None:
            unreadable.append((os.path.relpath(e.filename, root) if e.filename != root else root, str(e)))

        for folder, names, files in os.walk(root, onerror=failed):
            if should_stop():
                raise InterruptedError("stopped")
            names[:] = sorted(n for n in names if (self.include_hidden or not n.startswith(".")) and not n.lower().endswith(PACKAGES))
            for n in files:
                if self.include_hidden or not n.startswith("."):
                    path = os.path.join(folder, n)
                    add(path, os.path.relpath(path, root))
        return sorted(rows), unreadable

    def validate(self) -> None:
        """Raises SourceUnavailable unless the root can be read."""
        if not os.access(self.root, os.R_OK):
            raise SourceUnavailable(self.root)

    def scan(self, spark: SparkSession, should_stop=lambda: False) -> tuple[DataFrame, list[tuple[str, str]]]:
        rows, unreadable = self.walk(should_stop)
        df = spark.createDataFrame(rows, SCAN)
        df = df.withColumn("content_type", content_type_of(F.col("relative_path"))).withColumn("fingerprint", stable_hash(F.lit("local-file-v3"), F.col("document_id"), F.col("size"), F.col("modified_at"), F.col("changed_at")))
        return df, unreadable

    def payloads(self, scan: DataFrame) -> DataFrame:
        """scan with the files' contents, read by the executors: id, type, title, body and what an ingest needs."""
        where = F.regexp_replace("source_uri", "^file:/*", "file:///")
        content = scan.select(where.alias("source_uri")).mapInArrow(_read, "source_uri string, content binary")
        both = scan.withColumn("source_uri", F.regexp_replace("source_uri", "^file:/*", "file:///")).join(content, "source_uri", "left")
        return text_payloads(both)

    def fetch(self, spark: SparkSession, relative_path: str) -> DataFrame:
        """One file, which must lie in the root after links are resolved."""
        root, path = os.path.realpath(self.root), os.path.realpath(os.path.join(self.root, relative_path))
        if os.path.commonpath([root, path]) != root:
            raise PermissionError(f"{relative_path} is outside of the source")
        own = LocalFiles(path, self.connector_id, self.extensions, True, self.max_bytes)
        df, _ = own.scan(spark)
        return self.payloads(df.withColumn("document_id", F.lit(f"{self.connector_id}:{relative_path}")).withColumn("relative_path", F.lit(relative_path)))


#: Bytes of files that a worker holds at once, about.
HELD = 1 << 26


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of files that the executors can see; one that is gone by now has none."""

    def out(rows: list[tuple[str, bytes | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["source_uri", "content"])

    rows, held = [], 0
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            try:
                with open(uri.removeprefix("file://"), "rb") as f:
                    rows.append((uri, f.read()))
            except OSError:
                rows.append((uri, None))
            held += len(rows[-1][1] or b"")
            if held > HELD:
                yield out(rows)
                rows, held = [], 0
    if rows:
        yield out(rows)


def text_payloads(files: DataFrame) -> DataFrame:
    """Bodies of text-like files; others stand for themselves by name and path. Text that isn't UTF-8 is an error of its row."""
    text_like = is_text_like(F.col("content_type"))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    body = F.when(text_like & valid, F.col("content").cast("string")).when(text_like, F.lit(None)).otherwise(F.concat_ws("\n", "display_name", F.regexp_replace("source_uri", "^file://", "")))
    out = files.withColumn("body", body).withColumn("error", F.when(text_like & ~F.coalesce(valid, F.lit(False)), F.lit("unreadable text")))
    kind = representation_kind(F.col("content_type"))
    return out.withColumn("id", F.col("document_id")).withColumn("type", F.col("content_type")).withColumn("title", F.col("display_name")).withColumn("representation_id", F.concat("document_id", F.lit(":representation:"), kind)).drop("content")


def changes(previous: DataFrame | None, current: DataFrame, unreadable: list[tuple[str, str]] = (), connector_id: str = "local", re_emit: bool = False, cursor: str | None = None) -> DataFrame:
    """(seq, op, document_id, path, reason, cursor) between two file states (document_id, fingerprint).

    By seq: unreadable paths first, then deletes, permission changes of what
    lies under an unreadable path (not deleted: it may still be there), upserts,
    and the checkpoint, if a cursor is given. With re_emit (a root that moved)
    every current file is upserted.
    """
    spark = current.sparkSession
    if previous is None and unreadable:
        raise SourceUnavailable("; ".join(f"{p}: {r}" for p, r in unreadable))
    prev = current.select("document_id", "fingerprint").limit(0) if previous is None else previous.select("document_id", "fingerprint")
    both = prev.withColumnRenamed("fingerprint", "old").join(current.select("document_id", F.col("fingerprint").alias("new")), "document_id", "full_outer")
    root_gone = any(os.path.isabs(p) for p, _ in unreadable)
    path = F.substring("document_id", len(connector_id) + 2, 1 << 30)
    shield = F.lit(root_gone)
    for p, _ in unreadable:
        shield = shield | (path == p) | path.startswith(p + "/")
    changed = F.col("old").isNull() | (F.col("old") != F.col("new")) | F.lit(re_emit)
    op = F.when(F.col("new").isNull(), F.when(shield, "permissionChanged").otherwise("delete")).when(changed, "upsert")
    rows = both.withColumn("op", op).where("op IS NOT NULL").select("op", "document_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("reason"))
    if unreadable:
        rows = rows.unionByName(spark.createDataFrame([("pathUnavailable", None, p, r) for p, r in unreadable], "op string, document_id string, path string, reason string"))
    order = F.when(F.col("op") == "pathUnavailable", 0).when(F.col("op") == "delete", 1).when(F.col("op") == "permissionChanged", 2).otherwise(3)
    seq = order.cast("bigint") * (1 << 48) + F.monotonically_increasing_id()
    rows = rows.select(seq.alias("seq"), "op", "document_id", "path", "reason", F.lit(None).cast("string").alias("cursor"))
    if cursor is not None:
        rows = rows.unionByName(spark.createDataFrame([(4 << 48, "checkpoint", None, None, None, cursor)], rows.schema))
    return rows


def next_state(previous: DataFrame | None, current: DataFrame, events: DataFrame) -> DataFrame:
    """The file state to keep: the current one and, with their old fingerprints, shielded files."""
    now = current.select("document_id", "fingerprint")
    if previous is None:
        return now
    shielded = previous.select("document_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint")).join(events.where("op = 'permissionChanged'").select("document_id"), "document_id", "left_semi")
    return now.unionByName(shielded)


@dataclass
class Cursor:
    """The exported form of a file state."""

    root: str
    fingerprints: dict[str, str] = field(default_factory=dict)
    version: int = 3

    @property
    def fingerprint(self) -> str:
        own = [self.fingerprints[k] for k in sorted(self.fingerprints)]
        return f"{len(own)}|" + fnv1a_hex([b"".join(x.encode() + b"\xff" for x in (self.root, *own))])[0]

    def encode(self) -> str:
        data = json.dumps({"version": self.version, "rootPath": self.root, "fingerprint": self.fingerprint, "fileFingerprints": self.fingerprints}, sort_keys=True)
        return "z:" + base64.urlsafe_b64encode(zlib.compress(data.encode(), 9)).decode().rstrip("=")

    @classmethod
    def decode(cls, text: str) -> Cursor:
        """The compressed form, or plain JSON as older versions wrote it."""
        try:
            raw = text.encode()
            if text.startswith("z:"):
                raw = zlib.decompress(base64.urlsafe_b64decode(text[2:] + "=" * (-len(text[2:]) % 4)))
            data = json.loads(raw)
            if not 1 <= data["version"] <= 3:
                raise InvalidCursor(f"version {data['version']}")
            return cls(data["rootPath"], dict(data.get("fileFingerprints") or {k: "" for k in data.get("documentIDs", [])}), data["version"])
        except InvalidCursor:
            raise
        except Exception as e:
            raise InvalidCursor(str(e)) from e


def retry(failures: DataFrame, source: LocalFiles, spark: SparkSession) -> DataFrame:
    """Payloads of failed files that still are there and allowed."""
    scan, _ = source.scan(spark)
    return source.payloads(scan.join(failures.select("source_uri").distinct(), "source_uri", "left_semi"))
