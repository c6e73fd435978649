"""Schemas and documents from files, through Spark's readers; and sinks for verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.repeats import LONGEST
from ..operators.validate import CDDL

#: Fixed value: rows of a task; some documents take milliseconds each.
ROWS = 50_000
#: Fixed value: bytes of different documents that are judged apart from their rows.
FEW = 1 << 18


def read_schema(spark: SparkSession, path: str, names: bool = True) -> CDDL:
    """A schema file; several files under ``path`` are one schema, in the order of their names."""
    files = spark.read.format("binaryFile").load(path).select("path", "content").orderBy("path").collect()
    return CDDL(b"\n".join(bytes(f["content"]) for f in files), names)


def read_cbor(spark: SparkSession, path: str) -> DataFrame:
    """``(path, document)``, a document per file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("document"))


def read_cbor_hex(spark: SparkSession, path: str) -> DataFrame:
    """``(path, document)`` of files with hexadecimal text; null where the text isn't that."""
    text = F.regexp_replace("value", r"\s", "")
    good = text.rlike(r"\A([0-9A-Fa-f]{2})*\z")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.when(good, F.unhex(text)).alias("document"))


def read_json_documents(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """``(path, document)``: a JSON text per line, or per file.  Texts aren't parsed here."""
    return spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("path"), F.col("value").alias("document"))


def spread(df: DataFrame) -> DataFrame:
    """The rows of a file scan, dealt evenly to all cores, at most ``ROWS`` or so to a task.

    For work that is large for the bytes it reads.  How many splits a scan has says little: a row group is
    read by one task, and millions of narrow rows may be one group.  Rows are counted from the files' footers.
    """
    return _dealt(df, df.count())


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)))


def _survey(df: DataFrame, column: str) -> tuple[bool, int]:
    """Whether the different documents of a table are few and short, and how many rows it has.

    About how many differ is enough: the plan depends on it, results don't.
    """
    found = df.agg(F.approx_count_distinct(column), F.max(F.octet_length(column)), F.count("*")).first()
    longest = found[1] or 0
    return longest <= LONGEST and found[0] * longest <= FEW, found[2]


def by_document(df: DataFrame, column: str, work: Callable[[DataFrame, list[str]], DataFrame], few: bool = False) -> DataFrame:
    """``work(df, df.columns)``: rows of the key columns and of what each row's document gives, none for a null.

    What a document gives depends on nothing but ``column``: the document, or what it is made from.  Where
    different ones are few and short, it is worked out once for each and broadcast to its rows, which then neither
    move nor leave the JVM; otherwise rows are dealt as by ``spread``.  ``few`` saves a look at the table where
    that is certain.
    """
    rows = 0
    if not few:
        few, rows = _survey(df, column)
    if not few:
        return work(_dealt(df, rows), df.columns)
    each = work(_dealt(df.select(column).distinct(), 0), [column])
    return df.join(F.broadcast(each), column).select(*df.columns, *[c for c in each.columns if c != column])


def weighed(df: DataFrame, column: str, weight: str) -> DataFrame:
    """``(column, weight)``: documents and for how many rows each stands, for work that only counts rows.

    Each different document comes once where they are few and short; otherwise each row, dealt as by ``spread``.
    """
    few, rows = _survey(df, column)
    if few:
        return _dealt(df.groupBy(column).agg(F.count("*").alias(weight)), 0)
    return _dealt(df.select(column), rows).withColumn(weight, F.lit(1).cast("long"))


def write_verdicts(df: DataFrame, good: str, bad: str, verdict: str = "verdict") -> None:
    """Valid rows to one Parquet folder, all others with their verdicts to another.

    Rows are judged once: they are kept, on disk where memory is short, between the two writes.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        held.where(f"{verdict}.is_valid").drop(verdict).write.mode("append").parquet(good)
        held.where(f"not coalesce({verdict}.is_valid, false)").write.mode("append").parquet(bad)
    finally:
        held.unpersist()
