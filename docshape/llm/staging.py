"""Where the operators cut lineage: tables written to the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset, as in a
    local test session, a folder under the machine's temp folder is taken instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docshape-{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a finished write removes its own shuffle files.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later use of it neither
    recomputes it nor depends on any executor that made it, nor on shuffle files."""
    path = new_path(spark, name)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


#: Keys that count as heavy in ``join_by_weight`` have this fraction of all rows or more, so there are at
#: most so many: what is broadcast has a fixed bound whatever the data.
HEAVY = 4096


def join_by_weight(spark: SparkSession, big: DataFrame, small: DataFrame, key: str, weight: str) -> DataFrame:
    """``big`` joined (inner) to ``small``, which has one row for each key and ``weight``, its rows in ``big``.

    Rows of heavy keys stay where they are and meet a broadcast; the others are shuffled, and no
    key among them has more than 1 / ``HEAVY`` of all rows.  ``small`` must be materialized.
    """
    total = small.agg(F.sum(weight).alias("n")).first()["n"] or 0
    heavy = F.broadcast(small.where(F.col(weight) * HEAVY >= total))
    light = big.join(heavy.select(key), key, "left_anti").join(small.where(F.col(weight) * HEAVY < total), key)
    return big.join(heavy, key).unionByName(light)


#: Rows of one key that no task minds.
HOT = 4096


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` of the keys with most rows, small enough to broadcast: at most ``HEAVY``, of ``HOT`` rows or more each.

    A key that isn't among them has less than ``HOT`` rows, or less than 1 / ``HEAVY`` of all.
    """
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), key).limit(HEAVY)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
