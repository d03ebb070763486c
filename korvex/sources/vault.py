"""Markdown vaults: notes with optional frontmatter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.functions.text import trim
from korvex.sources.files import LocalFiles

_BLANK = "^[ \\t\\p{Zs}]+|[ \\t\\p{Zs}]+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def parse(notes: DataFrame, text: str = "contents", path: str = "relative_path") -> DataFrame:
    """notes with id, type, title, body, cluster_id: from the block between two --- lines, or the path, "note", and the first heading or file stem."""
    lines = F.split(F.col(text), "\n")
    opens = _strip(lines[0]) == "---"
    # Position of the closing line, from 1; 0 if there is none.
    closing = F.when(opens, F.array_position(F.transform(F.slice(lines, 2, 1 << 30), lambda x: _strip(x) == "---"), F.lit(True)) + 1).otherwise(F.lit(0))
    df = notes.withColumn("_lines", lines).withColumn("_end", F.when(closing > 1, closing).otherwise(F.lit(0)).cast("int"))
    block = F.when(F.col("_end") > 0, F.slice("_lines", 2, F.greatest(F.col("_end") - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    pairs = F.filter(F.transform(block, lambda x: F.struct(_strip(F.regexp_extract(x, "^([^:]*):", 1)).alias("key"), F.regexp_replace(_strip(F.regexp_extract(x, "^[^:]*:(.*)$", 1)), "^[\"']+|[\"']+$", "").alias("value"))), lambda p: p["key"] != "")
    df = df.withColumn("_pairs", pairs)

    def front(key: str) -> Column:
        own = F.filter("_pairs", lambda p: p["key"] == key)
        return F.when(F.size(own) > 0, F.element_at(own, -1)["value"])  # the last one counts

    body = F.when(F.col("_end") > 0, F.array_join(F.slice("_lines", F.col("_end") + 1, F.lit(1 << 30)), "\n")).otherwise(F.col(text))
    df = df.withColumn("_body", body)
    heads = F.filter(F.transform(F.split("_body", "\n"), _strip), lambda x: x.startswith("# "))
    heading = F.when(F.size(heads) > 0, _strip(F.substring(heads[0], 3, 1 << 30)))
    stem = F.regexp_replace(F.element_at(F.split(F.col(path), "/"), -1), "(?<=.)\\.[^.]*$", "")
    out = df.withColumn("id", F.coalesce(front("id"), F.col(path))).withColumn("type", F.coalesce(front("type"), F.lit("note")))
    out = out.withColumn("title", F.coalesce(front("title"), heading, stem)).withColumn("cluster_id", front("cluster")).withColumn("body", trim(F.col("_body")))
    return out.drop("_lines", "_end", "_pairs", "_body")


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Parsed notes of a folder, and what couldn't be read."""
    source = LocalFiles(root, "vault", ("md",))
    files, unreadable = source.scan(spark)
    notes = source.payloads(files).withColumnRenamed("body", "contents")
    keep = notes.select("relative_path", "source_uri", "contents", "error", "content_type", "representation_id")
    return parse(keep.where("error IS NULL")), unreadable + [(r.relative_path, r.error) for r in keep.where("error IS NOT NULL").select("relative_path", "error").collect()]


def ingest(client, root: str) -> dict:
    """Parses a folder's notes and upserts them; counts of accepted, failed and unreadable ones."""
    notes, unreadable = scan(client.spark, root)
    out = {"accepted": 0, "failed": 0}
    if notes.limit(1).count():
        out = client.ingest(notes.select("id", "type", "title", "body", "cluster_id", "source_uri", F.lit("vault").alias("source_id"), "content_type"))
    return out | {"unreadable": len(unreadable)}
