"""Validation of streams: stateless, so it is the batch operator on a stream."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..interp.walk import Options
from ..operators.validate import CDDL, validate


def validate_stream(stream: DataFrame, schema: CDDL | str, column: str, *, rule: str | None = None, model: str = "json", options: Options = Options()) -> DataFrame:
    return validate(stream, schema, column, rule=rule, model=model, options=options)


def issue_counts(stream: DataFrame, time: str, window: str = "10 minutes", late: str = "10 minutes", verdict: str = "verdict") -> DataFrame:
    """Issues by path and time window; rows later than the watermark are left out."""
    rows = stream.withWatermark(time, late).select(time, F.explode(f"{verdict}.issues.path").alias("path"))
    return rows.groupBy(F.window(time, window), "path").agg(F.count("*").alias("n_issues"))


def write_split(stream: DataFrame, good: str, bad: str, checkpoint: str, verdict: str = "verdict") -> StreamingQuery:
    """Valid documents to one folder and the rest, with verdicts, to a dead-letter folder.

    Each batch's rows are written under the batch's number, so that a batch that is tried again
    replaces what it wrote.
    """

    def split(batch: DataFrame, number: int) -> None:
        batch = batch.persist(StorageLevel.DISK_ONLY)  # judged once for both writes
        batch.where(f"{verdict}.is_valid").drop(verdict).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where(f"not coalesce({verdict}.is_valid, false)").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
