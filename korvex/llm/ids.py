"""Ids of any type as whole numbers, in the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from korvex.plans.util import quoted, written


def dtype(df: DataFrame, name: str) -> str:
    """The type of a column, as in a schema string."""
    return df.select(quoted(name)).schema[0].dataType.simpleString()


def numbered(df: DataFrame, id_col: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """df with its ids as bigint column name, and (name, id) to go back; None where ids are whole numbers anyway.

    Other ids are sorted (in ranges, not in one place) and numbered in that
    order, so that the smallest id has the smallest number. A null id stays null.
    """
    if isinstance(df.select(quoted(id_col)).schema[0].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return df.withColumn(name, quoted(id_col).cast("bigint")), None
    own = df.select(quoted(id_col).alias("id")).where("id IS NOT NULL").distinct().orderBy("id")
    known = written(own.select(F.monotonically_increasing_id().alias(name), "id"))
    here = known.select(F.col(name), F.col("id").alias(f"{name}_id"))
    return df.join(here, quoted(id_col) == F.col(f"{name}_id"), "left").drop(f"{name}_id"), known


def named(result: DataFrame, known: DataFrame | None, columns: list[str]) -> DataFrame:
    """result with the ids that its columns of numbers stand for."""
    if known is None:
        return result
    key = known.columns[0]
    for c in columns:
        own = known.select(F.col(key).alias(f"{c}_n"), F.col("id").alias(f"{c}_id"))
        result = result.join(own, result[c] == F.col(f"{c}_n")).withColumn(c, F.col(f"{c}_id")).drop(f"{c}_n", f"{c}_id")
    return result
