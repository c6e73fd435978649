"""Connected components by alternating large-star and small-star contraction.

Every step is a grouped minimum (combined map-side) and an equi-join of edges to the minima.  A
node may have a third of all edges: those of the heaviest nodes, at most ``staging.HEAVY``, stay where they are and
meet a broadcast of their minima; the others are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import HEAVY, HOT, discard, materialize

#: Rounds after which something is wrong: the contraction needs O(log^2 n) of them.
MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the ``m`` of their ``u``; ``least`` holds a row ``(u, m, n)`` for each, ``n`` its edges."""
    hot = least.where(F.col("n") >= HOT)
    if not hot.head(1):
        return edges.join(least, "u")
    hub = F.broadcast(hot.orderBy(F.desc("n"), "u").limit(HEAVY))
    return edges.join(hub, "u").unionByName(edges.join(hub.select("u"), "u", "left_anti").join(least, "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(spark: SparkSession, edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``edges`` but the components' smallest nodes.

    ``a`` and ``b`` name the two end columns, of one orderable type.  A component is named by
    its smallest node.  Null ends, self loops and repeated edges add nothing; no edges give an
    empty result.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    now = materialize(spark, now, f"{name}-0")
    seen = _fingerprint(now)
    for k in range(1, MAX_ROUNDS):
        if not seen[0]:
            break
        large = materialize(spark, _large_star(now), f"{name}-large-{k}")
        now, old = materialize(spark, _small_star(large), f"{name}-{k}"), now
        discard(spark, old, large)
        was, seen = seen, _fingerprint(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
