"""Embedders: the hashing bag of words, the interface for models, validation and reuse."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korvex.functions.text import fnv1a, tokens
from korvex.plans.util import small, spread

DIMENSION = 1024
#: Texts whose words are hashed at once.
ROWS = 500


class Embedder(Protocol):
    """What retrieval needs of a model; embed() turns a text column into vectors."""

    model_id: str
    dimension: int
    is_model_backed: bool
    weak_threshold: float
    modalities: tuple[str, ...]

    def embed(self, text: Column, kind: str = "document") -> Column: ...


def space_of(embedder: Embedder) -> str:
    """The name of the space that an embedder's vectors live in."""
    return getattr(embedder, "space_id", None) or f"{embedder.model_id}:{embedder.dimension}"


@dataclass(frozen=True)
class HashingEmbedder:
    """Counts of tokens by hash bucket, scaled to length one; a text without tokens is the zero vector."""

    dimension: int = DIMENSION
    model_id: str = "hashing-bow"
    is_model_backed: bool = False
    weak_threshold: float = 0.15
    modalities: tuple[str, ...] = ("text",)

    def embed(self, text: Column, kind: str = "document") -> Column:
        dimension = self.dimension

        @F.arrow_udf("array<float>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, int] = {}
            for lists in batches:
                rows = [r or [] for r in lists.to_pylist()]
                new = list({w for r in rows for w in r} - known.keys())
                if len(known) + len(new) > 1 << 19:
                    known.clear()
                    new = list({w for r in rows for w in r})
                known.update(zip(new, (int(h % np.uint64(dimension)) for h in fnv1a([w.encode("utf-8", "surrogatepass") for w in new]))))
                out = np.zeros((len(rows), dimension), np.float32)
                for k, r in enumerate(rows):
                    if r:
                        out[k] = np.bincount([known[w] for w in r], minlength=dimension)
                norm = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
                out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0, casting="unsafe")
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dimension, dtype=np.int32)), pa.array(out.ravel()))

        return run(tokens(text))


def resolve(*makers: Callable[[], Embedder | None], dimension: int = DIMENSION) -> tuple[Embedder, list[str]]:
    """The first embedder that can be made, the hashing one if none can, and why others couldn't."""
    reasons = []
    for make in makers:
        try:
            made = make()
        except Exception as e:  # noqa: BLE001 - a model that can't be loaded is passed over
            reasons.append(str(e))
            continue
        if made is not None:
            return made, reasons
    return HashingEmbedder(dimension), reasons


def buckets(texts: DataFrame, id_col: str, text_col: str, dimension: int = DIMENSION) -> DataFrame:
    """(id, bucket, weight): the non-zero entries of the hashing vectors."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                words = part.column(1).flatten().dictionary_encode()  # each word of a part is hashed once
                known = fnv1a([w.encode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()]) % np.uint64(dimension)
                flat = known[words.indices.to_numpy(zero_copy_only=False)].astype(np.int64) if len(words) else np.zeros(0, np.int64)
                sizes = pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False)
                key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * dimension + flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(key // dimension)), pa.array(key % dimension), pa.array(n.astype(np.float64))], ["id", "bucket", "n"])

    # A text's words are hashed and counted where the text is; counts are shuffled once, to their id, where all else is done.
    rows = spread(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", tokens(F.col("text")).alias("words"))
    counts = rows.mapInArrow(places, f"id {dict(rows.dtypes)['id']}, bucket bigint, n double").repartition("id").groupBy("id", "bucket").agg(F.sum("n").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("id")))
    return counts.select("id", "bucket", (F.col("n") / norm).alias("weight"))


def validated(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """vectors, failing on the first row whose vector hasn't the dimension."""
    ok = F.assert_true(F.size(column) == dimension, F.concat(F.lit(f"embedding dimension must be {dimension}, not "), F.size(column).cast("string")))
    return vectors.where(ok.isNull())


#: What a stored vector must agree on with the embedder to be used again.
REUSE = ["embedding_space_id", "dimension", "modality", "prompt_kind", "model_id", "backend"]


def cache_misses(chunks: DataFrame, embeddings: DataFrame, embedder: Embedder, backend: str = "spark-exact:1") -> DataFrame:
    """The chunks without a valid stored vector of the embedder's space."""
    valid = embeddings.where((F.col("embedding_space_id") == space_of(embedder)) & (F.col("dimension") == embedder.dimension) & (F.size("embedding") == embedder.dimension))
    valid = valid.where((F.col("modality") == "text") & (F.col("prompt_kind") == "document") & (F.col("model_id") == embedder.model_id) & (F.col("backend") == backend))
    return chunks.join(small(valid.select("chunk_id")), "chunk_id", "left_anti")  # few of them: no text is shuffled


def embed_chunks(chunks: DataFrame, embedder: Embedder, backend: str = "spark-exact:1") -> DataFrame:
    """Embedding rows of chunks."""
    return _rows(chunks.select("chunk_id", "document_id", embedder.embed(F.col("text")).alias("embedding"), F.lit("text").alias("modality")), embedder, backend)


def is_image(content_type: Column, source_uri: Column) -> Column:
    """Whether a payload is an image file that an embedder of images can read."""
    image = content_type.startswith("image/") | content_type.isin("public.image", "public.png", "public.jpeg", "public.tiff", "public.heic", "com.compuserve.gif")
    return F.coalesce(image & source_uri.startswith("file:"), F.lit(False))


def embed_images(chunks: DataFrame, embedder, backend: str = "spark-exact:1") -> DataFrame:
    """Embedding rows of image documents' chunks (with source_uri): one vector a file, repeated for its chunks and never reused."""
    vectors = chunks.select("document_id", "source_uri").distinct().select("document_id", embedder.embed_image(F.col("source_uri")).alias("embedding"))
    return _rows(chunks.select("chunk_id", "document_id").join(vectors, "document_id").withColumn("modality", F.lit("image")), embedder, backend)


def _rows(out: DataFrame, embedder: Embedder, backend: str) -> DataFrame:
    space = space_of(embedder)
    out = validated(out, embedder.dimension)
    return out.select(F.concat("chunk_id", F.lit(f":embedding:{space}")).alias("embedding_id"), "chunk_id", "document_id", F.lit(space).alias("embedding_space_id"), F.lit(embedder.model_id).alias("model_id"), F.lit(embedder.dimension).cast("bigint").alias("dimension"), "modality", F.lit("document").alias("prompt_kind"), F.lit(backend).alias("backend"), "embedding", F.unix_timestamp(F.current_timestamp()).cast("double").alias("created_at"))
