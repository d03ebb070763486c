"""Helpers shared by every plan: sessions, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest build side, in bytes, that join_checked sends to every executor.
BROADCAST_LIMIT = 8 << 20


def session(app: str = "korvex", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library expects."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of our own only where it names none and one machine runs all (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="korvex-checkpoint-")
    sc.setCheckpointDir(own)
    return own


class _Folders(threading.local):
    """Each thread's own, so that a scratch() deletes nothing of another thread's."""

    def __init__(self) -> None:
        self.paths: list[str] = []


#: Folders that written() made, until release() or a scratch() deletes them.
_written = _Folders()


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the tables that written() made in this thread; results that still read them are lost."""
    while len(_written.paths) > since:
        remove(spark, _written.paths.pop())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted in the end: for steps whose result is stored elsewhere by then."""
    since = len(_written.paths)
    try:
        yield
    finally:
        release(spark, since)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there; computed once, and safe against lost executors.

    Spark deletes the files with the last reference (session() asks for that).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like cut(), as compressed Parquet: for wide or textual intermediate tables, which stay until release()."""
    path = folder(df.sparkSession, "table")
    _written.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores where it is a scan of fewer files than those: for passes that are dear per row.

    Large tables have more splits than there are cores and stay as they are.
    """
    qe = df._jdf.queryExecution()
    if re.search("Exchange|Adaptive|InMemory", qe.executedPlan().toString()):
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if qe.toRdd().getNumPartitions() >= n else df.repartition(n)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, that no column of df has (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_columns(df: DataFrame) -> list[Column]:
    return [quoted(c) for c in df.columns]


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, marked for broadcast if its texts and numbers are measured to be few bytes."""
    limit = BROADCAST_LIMIT if limit is None else limit
    size = F.lit(16)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        own = F.octet_length(quoted(f.name)) if kind in ("string", "binary") else F.size(quoted(f.name)) * 24 if kind.startswith(("array", "map")) else F.lit(8)
        size = size + F.coalesce(own, F.lit(0)).cast("bigint")
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def row_hash(df: DataFrame) -> Column:
    """A hash of whole rows, whatever types they have (maps can't be hashed, so they are written out)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return F.xxhash64(*[F.to_json(F.struct(quoted(c))) if "map<" in kinds[c] else quoted(c) for c in df.columns])


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int = 24, limit: int | None = None) -> DataFrame:
    """big join small; small is broadcast only if its measured size is under limit, and shuffled otherwise.

    small should be cut or written before, since it is counted here.
    """
    limit = BROADCAST_LIMIT if limit is None else limit
    if small.count() * row_bytes <= limit:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("shuffle_merge"), on, how)
