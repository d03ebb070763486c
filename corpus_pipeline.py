"""The corpus pipeline: quality, exact and near dedup, source mixing, packing.

Defined results: null, empty and blank texts are rejected by the first stage;
rows that repeat an id are separate documents for the classifier, copies for
exact dedup (of equal texts the smallest id stays, then the smallest hash of
the row) and one document for near dedup; of a group of near copies the smallest
id stays; ties in mixing and packing go by a hash, then by id; an empty table
gives no rows; all columns of documents, whatever their names and types, pass
the first four stages unchanged. Packing counts words; its length_col takes the
token counts of the tokenizer that a model uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from korvex.llm import exact_dedup, mixing, packing, quality, simhash
from korvex.plans.util import folder, remove, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mix),
    ("packing", packed),
]

#: SQL cannot express the classifier, the fingerprints and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each is written as Parquet in the shared folder and read again.

    A stage's own tables and its input are deleted once its output is written;
    the last stage's stay for the result, until plans.util.release().
    """
    docs, before = table(spark, sf_dir, "documents"), None
    *first, (_, last) = STAGES
    for _, stage in first:
        path = folder(spark, "stage")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return last(spark, docs, sf_dir)
