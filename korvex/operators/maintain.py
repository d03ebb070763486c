"""Writes as plans over immutable tables: merges, deletes, versions, integrity, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korvex.plans.util import small


def merge(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Insert or update: new rows replace old ones of the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is new are added."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def delete_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on), on, "left_anti")


def soft_delete(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """documents with is_deleted set for the ids that are there."""
    gone = ids.select("document_id").distinct().withColumn("_gone", F.lit(True))
    return documents.join(gone, "document_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def current_mutations(changes: DataFrame, key: str = "document_id", seq: str = "seq") -> DataFrame:
    """Of each document the change that began last; what it supersedes is dropped."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def current_rows(changes: DataFrame, key: str, seq: str, place: str) -> DataFrame:
    """Like current_mutations(), for rows that are written and whose place is unique: only keys and places are shuffled, if few keys repeat."""
    last = changes.groupBy(key).agg(F.max_by(place, F.struct(seq, place)).alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    last = small(last.withColumnRenamed(key, "_key"))
    rows = changes.join(last, changes[key].eqNullSafe(last["_key"]), "left")
    return rows.where(F.col("_last").isNull() | (F.col("_last") == F.col(place))).drop("_key", "_last")


def next_documents(old: DataFrame, new: DataFrame, now) -> DataFrame:
    """Document rows after an ingest: the version grows only with new content, created_at stays, a deleted one comes back."""
    o = old.select("document_id", F.col("content_hash").alias("_hash"), F.col("version").alias("_version"), F.col("created_at").alias("_created"))
    out = new.join(o, "document_id", "left")
    out = out.withColumn("version", F.coalesce(F.col("_version") + (F.col("_hash") != F.col("content_hash")).cast("bigint"), F.lit(1).cast("bigint")))
    out = out.withColumn("created_at", F.coalesce("_created", now)).withColumn("modified_at", now).withColumn("ingested_at", now).withColumn("is_deleted", F.lit(False))
    return out.drop("_hash", "_version", "_created")


def missing_embeddings(chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, space: str) -> DataFrame:
    """Active chunks of documents that are there without a vector in the space."""
    own = embeddings.where(F.col("embedding_space_id") == space)
    live = chunks.where("active").join(documents.where(~F.col("is_deleted")).select("document_id"), "document_id", "left_semi")
    return live.join(own.select("chunk_id"), "chunk_id", "left_anti")


def missing_work(missing: DataFrame) -> DataFrame:
    """One row: chunks that can be embedded again, and those of other kinds that are skipped."""
    text = F.coalesce(F.col("modality"), F.lit("text")) == "text"
    return missing.agg(F.count_if(text).alias("rebuildable"), F.count_if(~text).alias("skipped"))


def purge_orphans(documents: DataFrame, versions: DataFrame, lineages: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> dict[str, DataFrame]:
    """Children without a parent are dropped, parents first."""
    d = documents.select("document_id")
    versions, lineages, chunks = (t.join(d, "document_id", "left_semi") for t in (versions, lineages, chunks))
    return {"versions": versions, "lineages": lineages, "chunks": chunks, "embeddings": embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi")}


def schema_version(migrations: DataFrame) -> DataFrame:
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


# Jobs and failures

ACTIVE_STATES = ("queued", "running", "paused")


def recover_interrupted(jobs: DataFrame, now) -> DataFrame:
    """Jobs that a stop left active become failed."""
    hit = F.col("state").isin(*ACTIVE_STATES)
    blank = F.coalesce("message", F.lit("")) == ""
    return jobs.withColumns({"state": F.when(hit, "failed").otherwise(F.col("state")), "finished_at": F.when(hit, F.coalesce(F.col("finished_at"), now)).otherwise(F.col("finished_at")), "message": F.when(hit & blank, "interrupted").otherwise(F.col("message"))})


def merged_history(durable: DataFrame, recent: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """Both histories by id; the newer row counts, of equal ones the recent one."""
    every = durable.withColumn("_recent", F.lit(0)).unionByName(recent.withColumn("_recent", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("_recent"))
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_recent")


def recent_first(rows: DataFrame, at: str, n: int, key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(at), key).limit(n)


def retry_sources(failures: DataFrame, scan: DataFrame) -> DataFrame:
    """Payloads of the current scan whose last ingest failed."""
    return scan.join(failures.select("source_uri").distinct(), "source_uri", "left_semi")


# Policies


def resolve_policies(policies: DataFrame, registered: DataFrame) -> DataFrame:
    """(policy_id, status, missing): satisfied if all required components are registered, quarantined otherwise."""
    need = policies.select("policy_id", F.explode_outer("required").alias("component"))
    out = need.join(registered.select("component").distinct().withColumn("_there", F.lit(True)), "component", "left")
    lacks = F.array_sort(F.collect_list(F.when(F.col("_there").isNull(), F.col("component"))))
    return out.groupBy("policy_id").agg(lacks.alias("missing")).withColumn("status", F.when(F.size("missing") == 0, "satisfied").otherwise("quarantined"))
