"""Removal of lines that many sites repeat, in DataFrame functions only.

For each distinct line (by two 64-bit hashes) a HyperLogLog sketch counts the sites that have it;
sketches merge by aggregation, map-side first, so that a line in a third of all documents costs
one sketch per task.  Lines whose estimate is near the threshold get an exact count of sites.
Of a line on too many sites only the earliest occurrence in the corpus stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import materialize

#: Sites from which on a line is boilerplate.
SITES = 10
#: Sketch size (log2 of its registers), and how far from the threshold an estimate is trusted:
#: ten standard errors, and one site at least.
LOG_K = 12
_BAND = 10 * 1.04 / (1 << (LOG_K // 2))


def _line_keys(line: Column) -> list[Column]:
    plain = F.trim(line)
    return [F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit("line"), plain).alias("h2")]


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, site, at, h1, h2)`` of every line that isn't blank."""
    site = F.coalesce(F.col("source").cast("string"), F.lit(""))
    cut = docs.select("doc_id", "mark", site.alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "")
    return cut.select("doc_id", "mark", "site", "at", *_line_keys(F.col("line")))


def boilerplate(spark: SparkSession, cut: DataFrame, sites: int = SITES) -> DataFrame:
    """``(h1, h2, first)`` of the lines on ``sites`` sites or more; ``first`` is the earliest place."""
    key = ["h1", "h2"]
    spread = cut.groupBy(*key).agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"), F.min(F.struct("doc_id", "mark", "at")).alias("first"))
    low, high = min(sites - 1, sites * (1 - _BAND)), max(sites + 1, sites * (1 + _BAND))
    counted = materialize(spark, spread.select(*key, "first", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= low), "lines-spread")
    near = counted.where(F.col("estimate") <= high).select(*key)
    exact = cut.join(near, key, "left_semi").groupBy(*key).agg(F.countDistinct("site").alias("n")).where(F.col("n") >= sites).select(*key)
    sure = counted.where(F.col("estimate") > high)
    return sure.select(*key, "first").unionByName(counted.join(exact, key, "left_semi").select(*key, "first"))


def _judged(spark: SparkSession, docs: DataFrame, sites: int) -> DataFrame:
    """``(row, text, n_lines, n_removed)``: a row of ``docs`` as a struct, its text less what goes, and counts."""
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"), "source")
    cut = materialize(spark, lines(base), "lines")  # hashes and places, no texts
    bad = materialize(spark, boilerplate(spark, cut, sites), "lines-boilerplate")
    here = F.struct(F.col("doc_id"), F.col("mark"), F.col("at"))
    gone = cut.join(bad, ["h1", "h2"]).where(~here.eqNullSafe(F.col("first"))).groupBy("doc_id", "mark").agg(F.collect_set("at").alias("places"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text")).alias("d")
    same = F.col("d.row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.mark") == F.col("g.mark"))
    parts, places = F.split("d.text", "\n"), F.col("g.places")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(places, i)), "\n")
    n_lines = F.when(F.col("d.text").isNull(), 0).otherwise(F.size(F.filter(parts, lambda x: F.trim(x) != ""))).cast("long")
    n_removed = F.when(places.isNull(), F.lit(0)).otherwise(F.size(places)).cast("long")
    return rows.join(gone.alias("g"), same, "left").select("d.row", F.when(places.isNotNull(), kept).otherwise(F.col("d.text")).alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` with ``text`` less its boilerplate lines, and columns n_lines and n_removed.

    A line counts without leading and trailing spaces; blank lines are never removed and not
    counted.  What stays keeps its order and line breaks.  A line is boilerplate from ``sites``
    distinct sites (column source) on; its earliest occurrence, by doc_id and place, stays.

    Defined cases: a null source is one more site; a null text stays null with 0 lines; a null
    doc_id comes before all others; repeated rows (equal doc_id and text) get equal results, so that
    the earliest occurrence stays in each of them.  Columns named n_lines or n_removed are replaced,
    any others stay as they are.  An empty table gives an empty result.
    """
    found = _judged(spark, docs, sites)
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return found.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own], "n_lines", "n_removed")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs``, all their columns and no others, less boilerplate lines; n_chars follows the text.

    A document whose lines all go (they stay elsewhere) goes; one that had none to begin with stays.
    """
    found = _judged(spark, docs, sites).where((F.col("n_removed") == 0) | (F.trim("text") != ""))

    def column(c: str) -> Column:
        own = F.col("row").getField(c)
        if c == "text":
            return F.col("text")
        return F.when(F.col("n_removed") > 0, F.length("text")).otherwise(own).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else own.alias(c)

    return found.select(*map(column, docs.columns))
