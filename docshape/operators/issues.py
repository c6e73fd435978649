"""Issues as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def explode_issues(df: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """One row for each issue: the key columns, its place in the report and its fields."""
    return df.select(*keys, F.posexplode(f"{verdict}.issues").alias("ord", "issue")).select(*keys, "ord", "issue.*")


def issues_by_path(df: DataFrame, verdict: str = "verdict", weight: str | None = None) -> DataFrame:
    """``(path, kind, n_issues)``: counts combine map-side.  A row stands for as many as its ``weight`` says."""
    n = F.count("*") if weight is None else F.sum(weight)
    return explode_issues(df, [weight] if weight else [], verdict).groupBy("path", "kind").agg(n.alias("n_issues"))


def deepest_issues(df: DataFrame, keys: list[str], k: int, verdict: str = "verdict") -> DataFrame:
    """The ``k`` deepest issues of each document, earlier ones first among equals.

    Ranked within each document's own array, so that nothing is shuffled.
    """
    depth = lambda i: F.size(F.split(i["path"], "/"))
    listed = F.transform(F.col(f"{verdict}.issues"), lambda i, at: F.struct((-depth(i)).alias("d"), at.alias("ord"), i.alias("issue")))
    top = F.slice(F.array_sort(listed), 1, k)
    return df.select(*keys, F.posexplode(top).alias("rank", "x")).select(*keys, (F.col("rank") + 1).alias("rank"), "x.ord", "x.issue.*")


def deepest_issues_by_window(issues: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The same over a table of exploded issues."""
    order = Window.partitionBy(*keys).orderBy(F.size(F.split("path", "/")).desc(), "ord")
    return issues.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
