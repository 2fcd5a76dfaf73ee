"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node that a node is connected with.

    Each step is two shuffles of the edges; stars of any size are handled by streaming windows.
    Edges with a null end are ignored; a loop makes its node a component; nodes without an edge
    don't appear; repeated edges count once; an empty table gives none.
    """
    pairs = edges.where(edges[src].isNotNull() & edges[dst].isNotNull()).select(edges[src].cast("long").alias("a"), edges[dst].cast("long").alias("b"))
    e = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    by_u = Window.partitionBy("u")
    seen = None
    while (now := _digest(e)) != seen:
        seen = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(by_u), F.col("u"))).where("v > u or v = m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(by_u))
        e = materialize(
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").distinct(), "cc"
        )
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
