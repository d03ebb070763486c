"""One index: ingest, delete, search, browse, rebuild, and what happened."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korvex.functions.text import representation_kind
from korvex.operators import browse as B
from korvex.operators import chunking, embedding
from korvex.operators import maintain as M
from korvex.operators import retrieval as R
from korvex.plans.migrations import migrate, reindex
from korvex.plans.store import KEYED, Corpus, fold
from korvex.plans.util import cut, scratch, small, written

#: Columns of a payload that may be missing, and what stands for them.
_OPTIONAL = {"type": "public.plain-text", "title": None, "source_id": None, "source_uri": None, "cluster_id": None, "policy_id": "default", "representation_id": None, "content_type": None, "modality": "text", "error": None}


class EmbeddingSpaceMismatch(RuntimeError):
    """The index has vectors, but none of the embedder's space."""


class AllFailed(RuntimeError):
    """No payload of an ingest could be used; failed: how many there were."""

    def __init__(self, failed: int):
        super().__init__(f"all {failed} payloads failed")
        self.failed = failed


class IndexClient:
    """Operations over one corpus; every write is one new generation."""

    def __init__(self, spark: SparkSession, root: str, embedder: embedding.Embedder | None = None, stem: bool = True):
        self.spark, self.corpus = spark, Corpus(spark, root)
        self.embedder = embedder or embedding.HashingEmbedder()
        self.stem = stem
        self.recent: list[dict] = []
        #: Seconds that the channels of the last search took.
        self.timings: dict[str, float] = {}
        migrate(self.corpus)
        if self.corpus.index["stem"] not in (None, stem):
            self.reindex()
        jobs = self.corpus.read("jobs")
        if jobs.where(F.col("state").isin(*M.ACTIVE_STATES)).limit(1).count():  # a stop left them
            self.corpus.commit({"jobs": M.recover_interrupted(jobs, F.lit(time.time()))})

    @property
    def space(self) -> str:
        return embedding.space_of(self.embedder)

    def _job(self, kind: str, state: str, began: float, message: str = "") -> DataFrame:
        row = (uuid.uuid4().hex, kind, state, message, began, time.time(), time.time())
        self.recent.append(dict(zip(("id", "kind", "state", "message", "started_at", "finished_at", "updated_at"), row)))
        return M.merge(self.corpus.read("jobs"), self.spark.createDataFrame([row], self.corpus.read("jobs").schema), ["id"])

    # Writes

    def ingest(self, payloads: DataFrame, registered: set[str] | None = None, required: dict[str, list[str]] | None = None, deletes: DataFrame | None = None) -> dict[str, Any]:
        """Upserts payloads (id, body and optional columns; seq orders changes of one document), and deletes documents (document_id), in one commit.

        A payload with an error is recorded as a failure and stops no other.
        Payloads whose policy needs a component that isn't registered are
        quarantined. Only the buckets of the documents that change are rewritten.
        """
        with scratch(self.spark):  # the store has what was written on the way
            return self._ingest(payloads, registered, required, deletes)

    def _ingest(self, payloads: DataFrame, registered: set[str] | None, required: dict[str, list[str]] | None, deletes: DataFrame | None) -> dict[str, Any]:
        began, now = time.time(), F.lit(time.time())
        for name, default in _OPTIONAL.items():
            if name not in payloads.columns:
                payloads = payloads.withColumn(name, F.lit(default).cast("string"))
        payloads = payloads.withColumn("policy_id", F.coalesce("policy_id", F.lit("default"))).withColumn("title", F.coalesce("title", "id")).withColumn("content_type", F.coalesce("content_type", "type"))
        if required:
            lacking = [p for p, need in required.items() if set(need) - (registered or set())]
            payloads = payloads.withColumn("error", F.when(F.col("policy_id").isin(lacking), "quarantined").otherwise(F.col("error")))
        if "seq" not in payloads.columns:
            payloads = payloads.withColumn("seq", F.monotonically_increasing_id())
        # Texts are written once, with what depends on a row alone; windows are cut from there each time they are needed.
        default_kind = F.concat("id", F.lit(":representation:"), representation_kind(F.col("content_type")))
        payloads = payloads.withColumn("size", F.octet_length(F.coalesce("body", F.lit("")))).withColumn("representation_id", F.coalesce("representation_id", default_kind))
        if "image" in self.embedder.modalities:
            payloads = payloads.withColumn("modality", F.when(embedding.is_image(F.col("content_type"), F.col("source_uri")), "image").otherwise(F.col("modality")))
        payloads = written(chunking.with_ids(payloads).withColumn("document_id", F.col("id")).withColumn("_place", F.monotonically_increasing_id()))
        payloads = M.current_rows(payloads, "id", "seq", "_place")
        good = payloads.where(F.col("error").isNull() & F.col("id").isNotNull())
        bad = payloads.where(F.col("error").isNotNull() | F.col("id").isNull())
        failed, accepted = bad.count(), good.count()
        c = self.corpus
        failures = bad.select(F.expr("uuid()").alias("id"), F.col("id").alias("document_id"), "source_uri", F.when(F.col("error") == "quarantined", "policyUnresolved").otherwise("extractionFailure").alias("category"), F.coalesce("error", F.lit("missing id")).alias("message"), now.alias("occurred_at"))
        tables: dict[str, DataFrame] = {}
        if failed:
            tables["failures"] = c.read("failures").unionByName(failures)
        gone = self._there(deletes) if deletes is not None else None
        n_gone = 0 if gone is None else gone.count()
        own: set[int] = set()
        delta = index = None
        if accepted or n_gone:
            new = good
            ids = new.select("document_id")
            changed = ids if gone is None else ids.unionByName(gone).distinct()
            own = c.buckets(changed)
            old = {name: c.read(name, own) for name in KEYED}
            documents = M.next_documents(old["documents"], new.select("document_id", "type", "title", "source_id", "source_uri", "cluster_id", "content_type", "content_hash", F.col("size").cast("bigint").alias("size")), now)
            tables["documents"] = M.merge(old["documents"] if gone is None else M.soft_delete(old["documents"], gone), documents, ["document_id"])
            tables["versions"] = M.insert_ignore(old["versions"], new.select("version_id", "document_id", "content_hash", now.alias("created_at")), ["version_id"])
            kept = M.delete_keys(old["representations"], new.select("lineage_id"), ["lineage_id"])
            kept = kept if gone is None else M.delete_keys(kept, gone, ["document_id"])
            tables["representations"] = kept.unionByName(new.select(F.col("active_representation_id").alias("representation_id"), "lineage_id", "document_id", F.element_at(F.split("lineage_id", ":"), -1).alias("kind"), F.col("body").alias("text")))
            carried = ("lineage_id", "policy_id", "modality", "title", "source_uri")

            def windows(columns: list[str]) -> DataFrame:
                made = chunking.chunk(new, "document_id", columns=["content_hash", "occurrence", *columns], keep=carried)
                return chunking.chunk_ids(made).withColumn("active", F.lit(True)).withColumn("created_at", now)

            fresh = windows([c for c in chunking.COLUMNS if c not in ("content_hash", "occurrence")])
            names, after = windows([]), windows(["text"])
            tables["chunks"] = M.delete_keys(old["chunks"], changed, ["document_id"]).unionByName(fresh.drop("title", "source_uri"))
            # Vectors of chunks that stayed are used again, in every space; others go.
            stale = old["embeddings"].join(changed, "document_id", "left_semi").join(names.select("chunk_id"), "chunk_id", "left_anti")
            live = M.delete_keys(old["embeddings"], stale, ["chunk_id"])
            misses = embedding.cache_misses(after.where("modality = 'text'"), old["embeddings"], self.embedder)
            made = embedding.embed_chunks(misses, self.embedder)
            if "image" in self.embedder.modalities:
                images = names.where("modality = 'image'")
                made = made.unionByName(embedding.embed_images(images, self.embedder))
            made = written(made)
            tables["embeddings"] = M.delete_keys(live, made.select("embedding_id"), ["embedding_id"]).unionByName(made)
            before = old["chunks"].where("active").join(changed, "document_id", "left_semi").join(old["documents"].where(~F.col("is_deleted")).select("document_id", "title", "source_uri"), "document_id")
            delta, index = self._index_delta(before, after)
        state = "failed" if failed and not accepted and not n_gone else "succeeded"
        tables["jobs"] = self._job("ingest", state, began, f"{accepted} accepted, {failed} failed" + (f", {n_gone} deleted" if n_gone else ""))
        c.commit(tables, own, delta, index)
        if state == "failed":
            raise AllFailed(failed)
        return {"accepted": accepted, "failed": failed} | ({"deleted": n_gone} if deletes is not None else {})

    def _index_delta(self, before: DataFrame, after: DataFrame) -> tuple[DataFrame, dict]:
        """Postings of chunks (with title and source_uri) that went and came, and what the index has then."""
        text = R.index_text("text", "title", "source_uri")
        came, went = (rows.select("chunk_id", text.alias("text"), F.sha2(text, 256).alias("_hash")) for rows in (after, before))
        old_texts, new_texts = went.select("chunk_id", "_hash"), came.select("chunk_id", "_hash")
        if before.limit(1).count():
            # Chunks that went and came with the same text cancel out before their text is cut.
            went, came = M.delete_keys(went, new_texts, ["chunk_id", "_hash"]), came.join(small(old_texts), ["chunk_id", "_hash"], "left_anti")
        parts = [R.counted(rows, F.col("text"), ["chunk_id"], self.stem).withColumn("sign", F.lit(sign).cast("bigint")) for sign, rows in ((1, came), (-1, went))]
        rows = written(parts[0].unionByName(parts[1]))
        n, length, least = rows.agg(F.coalesce(F.sum("sign"), F.lit(0)), F.coalesce(F.sum(F.col("length") * F.col("sign")), F.lit(0)), F.min("sign")).first()
        delta = R.inverted(rows, "sign")
        delta = fold(delta) if least == -1 else delta
        old = self.corpus.index
        return delta, {"chunks": old["chunks"] + n, "length": old["length"] + length, "stem": self.stem}

    def reindex(self) -> None:
        """Builds the keyword index anew, with or without stems."""
        reindex(self.corpus, self.stem)

    def _there(self, ids: DataFrame) -> DataFrame:
        """Of the ids, those of documents that aren't deleted."""
        c = self.corpus
        ids = ids.select("document_id").distinct()
        return written(c.read("documents", c.buckets(ids)).where(~F.col("is_deleted")).join(ids, "document_id", "left_semi").select("document_id"))

    def delete(self, document_ids: DataFrame | list[str]) -> int:
        """Deletes documents that are there; their versions stay."""
        began, c = time.time(), self.corpus
        ids = document_ids if isinstance(document_ids, DataFrame) else self.spark.createDataFrame([(i,) for i in document_ids], "document_id string")
        ids = self._there(ids)
        n = ids.count()
        if n:
            own = c.buckets(ids)
            old = {name: c.read(name, own) for name in KEYED}
            tables = {name: M.delete_keys(old[name], ids, ["document_id"]) for name in ("representations", "chunks", "embeddings")}
            before = old["chunks"].where("active").join(ids, "document_id", "left_semi").join(old["documents"].select("document_id", "title", "source_uri"), "document_id")
            delta, index = self._index_delta(before, before.limit(0))
            c.commit(tables | {"documents": M.soft_delete(old["documents"], ids), "jobs": self._job("delete", "succeeded", began, f"{n} deleted")}, own, delta, index)
        return n

    def rebuild_embeddings(self) -> dict[str, int]:
        """Embeds what has no vector in the active space; stops at any point and goes on with what is left."""
        began, c = time.time(), self.corpus
        missing = written(M.missing_embeddings(c.read("chunks"), c.read("documents"), c.read("embeddings"), self.space))
        work = M.missing_work(missing).first()
        if work.rebuildable:
            made = written(embedding.embed_chunks(missing.where("modality = 'text'"), self.embedder))
            own = c.buckets(made)
            c.commit({"embeddings": c.read("embeddings", own).unionByName(made), "jobs": self._job("rebuild", "succeeded", began)}, own)
        return {"rebuilt": work.rebuildable, "skipped": work.skipped}

    def persist_policies(self, policies: DataFrame, registered: DataFrame) -> DataFrame:
        status = M.resolve_policies(policies, registered)
        rows = policies.withColumn("version", F.lit(1).cast("bigint")).join(status, "policy_id")
        self.corpus.commit({"policies": M.merge(self.corpus.read("policies"), rows, ["policy_id"])})
        return status

    # Reads

    def search(self, queries: str | DataFrame, request: R.SearchRequest = R.SearchRequest()) -> tuple[DataFrame, dict[str, Any]]:
        """Hits of one query or of a table (query_id, query), and diagnostics."""
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([(0, queries)], "query_id bigint, query string")
        queries = queries.where(F.trim("query") != "")
        limit, exact, fts, vector = request.budgets()
        c = self.corpus
        chunks, documents, embeddings = c.read("chunks"), c.read("documents"), c.read("embeddings")
        diagnostics: dict[str, Any] = {"missing_channels": [], "orphaned_space": False}
        if limit <= 0:
            queries = queries.limit(0)
            limit = 1
        # A cluster filter of this interface is a hard scope.
        scope = R.Scope(request.filters.cluster_id, True) if request.filters.cluster_id else request.scope
        filters = replace(request.filters, cluster_id=None)
        pool = R.candidates(chunks, documents, filters, scope, embeddings)
        channels: dict[str, DataFrame] = {}
        self.timings = {}

        def take(name: str, make: Callable[[], DataFrame]) -> None:
            """Runs a channel (k rows a query at most); one that fails is missing, and the search goes on without it."""
            began = time.perf_counter()
            try:
                channels[name] = cut(make())
                self.timings[name] = time.perf_counter() - began
            except Exception as e:  # noqa: BLE001 - whatever broke, in planning or in a task
                if request.strict:
                    raise
                diagnostics["missing_channels"].append(name)
                diagnostics[f"{name}_error"] = str(e)[:500]

        if exact > 0:
            take("exact", lambda: R.exact_channel(queries, pool, exact, documents.where(~F.col("is_deleted"))))
        if fts > 0:
            have, terms = c.index, R.query_terms(queries, self.stem)
            stats = (have["chunks"], have["length"] / have["chunks"] if have["chunks"] else None)
            take("fts", lambda: R.keyword_channel(queries, c.postings(terms), stats, pool, fts, self.stem))
        if vector > 0:
            space = filters.embedding_space_id
            if space is not None and space != self.space:
                if request.strict:
                    raise EmbeddingSpaceMismatch(f"{space} is not the embedder's space {self.space}")
                diagnostics["missing_channels"].append("vector")
            else:
                cover = B.coverage(chunks, embeddings)
                diagnostics["orphaned_space"] = B.is_orphaned(cover, self.space)
                if diagnostics["orphaned_space"] and request.strict:
                    raise EmbeddingSpaceMismatch(self.space)
                own = embeddings.where((F.col("embedding_space_id") == self.space) & (F.col("dimension") == self.embedder.dimension)).select("chunk_id", "embedding")
                own = own.join(pool.select("chunk_id"), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
                take("vector", lambda: R.vector_channel(queries.select("query_id", self.embedder.embed(F.col("query"), "query").alias("vector")), own, vector))
        if not channels:
            channels["exact"] = self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_id string, rank bigint, score double")
        fused = R.fuse(channels, limit, pool, scope)
        hits = R.with_weakness(fused, self.embedder.weak_threshold)
        return R.hydrate(hits, queries, chunks, documents, embeddings, filters.embedding_space_id or self.space), diagnostics

    def browse(self, request: B.BrowseRequest = B.BrowseRequest()) -> dict[str, Any]:
        c = self.corpus
        d, k, e = c.read("documents"), c.read("chunks"), c.read("embeddings")
        return {"documents": B.page(d, k, request, e), "total": B.total(d, k, request, e), "facets": B.facets(d)}

    def chunks(self, document_id: str) -> DataFrame:
        return B.inspect_chunks(self.corpus.read("chunks"), self.corpus.read("embeddings"), document_id).orderBy("ordinal")

    def counts(self) -> DataFrame:
        c = self.corpus
        return B.counts(c.read("documents"), c.read("chunks"), c.read("embeddings"), self.space)

    def snapshot(self) -> dict[str, Any]:
        row = self.counts().first().asDict()
        cover = {r.embedding_space_id: r.n for r in B.coverage(self.corpus.read("chunks"), self.corpus.read("embeddings")).collect()}
        return row | {"generation": self.corpus.generation, "bytes": self.corpus.byte_size(), "spaces": cover}

    def model_status(self) -> dict[str, Any]:
        return {"model_id": self.embedder.model_id, "dimension": self.embedder.dimension, "space": self.space, "is_model_backed": self.embedder.is_model_backed}

    def health(self) -> dict[str, Any]:
        cover = B.coverage(self.corpus.read("chunks"), self.corpus.read("embeddings"))
        failed = self.corpus.read("failures").count()
        orphaned = B.is_orphaned(cover, self.space)
        return {"status": "degraded" if orphaned or failed else "ok", "failures": failed, "orphaned_space": orphaned}

    def jobs(self, limit: int = 50) -> DataFrame:
        return M.recent_first(self.corpus.read("jobs"), "updated_at", limit)

    def failures(self, limit: int = 50) -> DataFrame:
        return M.recent_first(self.corpus.read("failures"), "occurred_at", limit)

    def clear_failures(self, ids: list[str] | None = None) -> None:
        old = self.corpus.read("failures")
        self.corpus.commit({"failures": old.limit(0) if ids is None else old.where(~F.col("id").isin(ids))})

    def diagnostic_history(self, limit: int = 50) -> dict[str, DataFrame]:
        jobs = self.corpus.read("jobs")
        recent = self.spark.createDataFrame([tuple(r[c] for c in jobs.columns) for r in self.recent], jobs.schema)
        return {"jobs": M.recent_first(M.merged_history(jobs, recent), "updated_at", limit), "failures": self.failures(limit)}

    @staticmethod
    def retrieval_pipeline() -> dict[str, Any]:
        return dict(R.PIPELINE)
