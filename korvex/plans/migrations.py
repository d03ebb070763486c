"""Versions of the schema, as functions over a corpus's tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvex.operators import retrieval as R
from korvex.operators.maintain import merge, purge_orphans, schema_version
from korvex.plans.store import SCHEMA_VERSION, SCHEMAS, Corpus
from korvex.plans.util import written

Tables = dict[str, DataFrame]


def _nothing(t: Tables) -> Tables:
    """Columns that older files lack are read as nulls."""
    return {}


def _integrity(t: Tables) -> Tables:
    """Rows whose document, and vectors whose chunk isn't there, go."""
    kept = purge_orphans(t["documents"], t["versions"], t["representations"], t["chunks"], t["embeddings"])
    return {"versions": kept["versions"], "representations": kept["lineages"], "chunks": kept["chunks"], "embeddings": kept["embeddings"]}


def _modality(t: Tables) -> Tables:
    """A chunk without a modality has that of its newest vector, or is text; so are vectors without one."""
    e = t["embeddings"].withColumn("modality", F.coalesce(F.nullif("modality", F.lit("")), F.lit("text"))).withColumn("prompt_kind", F.coalesce(F.nullif("prompt_kind", F.lit("")), F.lit("document")))
    newest = e.groupBy("chunk_id").agg(F.max_by("modality", F.struct(F.coalesce("created_at", F.lit(0.0)), "embedding_id")).alias("_modality"))
    c = t["chunks"].join(newest, "chunk_id", "left").withColumn("modality", F.coalesce(F.nullif("modality", F.lit("")), "_modality", F.lit("text"))).drop("_modality")
    return {"chunks": c, "embeddings": e}


#: Version 3 only added columns. Version 5 dropped index entries without a chunk; version 6 keeps the index, which reindex() builds.
STEPS: dict[int, Callable[[Tables], Tables]] = {1: _nothing, 2: _integrity, 3: _nothing, 4: _modality, 5: _nothing, 6: _nothing}


def reindex(corpus: Corpus, stem: bool = True, tables: Tables | None = None) -> None:
    """Builds the keyword index from the chunks of documents that are there."""
    chunks, documents = corpus.read("chunks"), corpus.read("documents")
    live = chunks.where("active").join(documents.where(~F.col("is_deleted")).select("document_id", "title", "source_uri"), "document_id")
    postings = written(R.postings(live, R.index_text("text", "title", "source_uri"), stem=stem).withColumn("sign", F.lit(1).cast("bigint")))
    length = postings.agg(F.sum("tf")).first()[0] or 0
    corpus.state["segments"] = []
    corpus.commit(tables or {}, None, postings, {"chunks": live.count(), "length": length, "stem": stem})


def migrate(corpus: Corpus) -> list[int]:
    """Applies the versions that a corpus lacks, each as one generation; gives their numbers."""
    done = []
    at = schema_version(corpus.read("migrations")).first().version
    for v in range(at + 1, SCHEMA_VERSION + 1):
        changed = STEPS[v]({name: corpus.read(name) for name in SCHEMAS})
        row = corpus.spark.createDataFrame([(v, time.time())], SCHEMAS["migrations"])
        rows = changed | {"migrations": merge(corpus.read("migrations"), row, ["version"])}
        if v == 6:
            reindex(corpus, tables=rows)
        else:
            corpus.commit(rows)
        done.append(v)
    return done
