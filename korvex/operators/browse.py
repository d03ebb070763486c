"""The document browser: filters, ten orders, pages, totals, facets, counts, chunk lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvex.functions.text import ascii_lower, contains_literal

_TITLE = ascii_lower


def _orders() -> dict[str, list[Column]]:
    out = {}
    for name, key in (("ingestedAt", F.col("ingested_at")), ("modifiedAt", F.col("modified_at")), ("title", _TITLE(F.col("title"))), ("size", F.col("size")), ("chunkCount", F.col("active_chunk_count"))):
        out[f"{name}Descending"] = [key.desc_nulls_last(), F.col("document_id").asc()]
        out[f"{name}Ascending"] = [key.asc_nulls_first(), F.col("document_id").asc()]
    return out


ORDERS = ["ingestedAtDescending", "ingestedAtAscending", "modifiedAtDescending", "modifiedAtAscending", "titleAscending", "titleDescending", "sizeDescending", "sizeAscending", "chunkCountDescending", "chunkCountAscending"]


@dataclass(frozen=True)
class BrowseRequest:
    query: str = ""
    cluster_id: str | None = None
    source_ids: tuple[str, ...] | None = None
    content_types: tuple[str, ...] | None = None
    policy_id: str | None = None
    embedding_space_id: str | None = None
    sort: str = "ingestedAtDescending"
    limit: int = 50
    offset: int = 0


def summaries(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that are there, with active_chunk_count and the policy of their newest active chunk."""
    per = chunks.where("active").groupBy("document_id").agg(F.count(F.lit(1)).alias("active_chunk_count"), F.max_by("policy_id", F.struct("created_at", "chunk_id")).alias("policy_id"))
    out = documents.where(~F.col("is_deleted")).join(per, "document_id", "left")
    return out.withColumn("active_chunk_count", F.coalesce("active_chunk_count", F.lit(0)).cast("bigint"))


def filtered(documents: DataFrame, chunks: DataFrame, request: BrowseRequest, embeddings: DataFrame | None = None) -> DataFrame:
    d = documents.where(~F.col("is_deleted"))
    if request.query.strip():
        q = F.lit(request.query.strip())
        d = d.where(contains_literal(F.col("title"), q) | contains_literal(F.col("document_id"), q) | contains_literal(F.coalesce("source_uri", F.lit("")), q))
    for column, value in (("cluster_id", request.cluster_id), ("source_id", request.source_ids), ("content_type", request.content_types)):
        if value is not None:
            d = d.where(F.col(column) == value if isinstance(value, str) else F.col(column).isin(sorted(value)))
    if request.policy_id is not None:
        d = d.join(chunks.where(F.col("active") & (F.col("policy_id") == request.policy_id)).select("document_id"), "document_id", "left_semi")
    if request.embedding_space_id is not None and embeddings is not None:
        own = embeddings.where(F.col("embedding_space_id") == request.embedding_space_id).select("chunk_id")
        d = d.join(chunks.where("active").join(own, "chunk_id", "left_semi").select("document_id"), "document_id", "left_semi")
    return d


def ordered(rows: DataFrame, sort: str) -> DataFrame:
    return rows.orderBy(*_orders()[sort])


def page(documents: DataFrame, chunks: DataFrame, request: BrowseRequest, embeddings: DataFrame | None = None) -> DataFrame:
    """One page of the summaries; the order's top rows are kept by each task, not the whole table sorted."""
    own = filtered(documents, chunks, request, embeddings)
    rows = summaries(own, chunks.join(own.select("document_id"), "document_id", "left_semi"))
    return ordered(rows, request.sort).offset(request.offset).limit(request.limit)


def total(documents: DataFrame, chunks: DataFrame, request: BrowseRequest, embeddings: DataFrame | None = None) -> int:
    return filtered(documents, chunks, request, embeddings).count()


def facets(documents: DataFrame) -> DataFrame:
    """(facet, value) of sources and content types, distinct and not empty, in order; paging and filters don't matter."""
    d = documents.where(~F.col("is_deleted"))
    both = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("source_id", "content_type")])).alias("x")).select("x.*")
    return both.where("value IS NOT NULL AND value <> ''").distinct().orderBy("facet", ascii_lower(F.col("value")), "value")


def keyset_page(chunks: DataFrame, after: tuple | None, n: int) -> DataFrame:
    """The n next chunks by (document_id, ordinal, chunk_id) after a key."""
    key = ["document_id", "ordinal", "chunk_id"]
    if after is not None:
        chunks = chunks.where(F.struct(*key) > F.struct(F.lit(after[0]).alias("document_id"), F.lit(after[1]).cast("bigint").alias("ordinal"), F.lit(after[2]).alias("chunk_id")))
    return chunks.orderBy(*key).limit(n)


def inspect_chunks(chunks: DataFrame, embeddings: DataFrame, document_id: str | None = None) -> DataFrame:
    """Active chunks in order, with has_embedding."""
    c = chunks.where("active")
    if document_id is not None:
        c = c.where(F.col("document_id") == document_id)
    own = embeddings.select("chunk_id").distinct().withColumn("has_embedding", F.lit(True))
    return c.join(own, "chunk_id", "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))


def counts(documents: DataFrame, chunks: DataFrame, embeddings: DataFrame, space: str) -> DataFrame:
    """One row: documents, active chunks, and vectors of active chunks in the space."""
    active = chunks.where("active")
    a = documents.agg(F.count_if(~F.col("is_deleted")).alias("documents"))
    b = active.agg(F.count(F.lit(1)).alias("active_chunks"))
    c = embeddings.where(F.col("embedding_space_id") == space).join(active.select("chunk_id"), "chunk_id", "left_semi").agg(F.count(F.lit(1)).alias("embeddings"))
    return a.crossJoin(b).crossJoin(c)


def coverage(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(embedding_space_id, n) over active chunks."""
    return embeddings.join(chunks.where("active").select("chunk_id"), "chunk_id", "left_semi").groupBy("embedding_space_id").agg(F.count(F.lit(1)).alias("n"))


def is_orphaned(cover: DataFrame, space: str) -> bool:
    """Whether other spaces have vectors and this one has none."""
    row = cover.agg(F.sum(F.when(F.col("embedding_space_id") == space, F.col("n"))).alias("own"), F.sum("n").alias("all")).first()
    return not row.own and bool(row["all"])


def percentiles(rows: DataFrame, value: str, by: list[str], ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest-rank percentiles, pNN columns."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{round(p * 100)}") for p in ps])


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
