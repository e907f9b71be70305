"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, shared_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): each linked id and the smallest id that it reaches; roots themselves are included.

    Every round hangs each node's larger neighbours under its smallest one, then each node's smaller ones;
    the links become stars in a number of rounds logarithmic in practice. Rounds end in the shared folder. A null end or a
    link to itself is ignored; no links give no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = shared_table(spark, edges, "links")
    while True:
        # stars, if each node hangs under one other at most and those under which any hangs under none
        ends = edges.select(F.col("hi").alias("id"), F.lit(1).alias("h"), F.lit(0).alias("l")).unionAll(edges.select("lo", F.lit(0), F.lit(1)))
        state = ends.groupBy("id").agg(F.sum("h").alias("h"), F.max("l").alias("l")).agg(F.sum("h").alias("n"), F.count_if(F.expr("h > 1 or h = 1 and l = 1")).alias("bad")).first()
        n = state["n"] or 0
        if not state["bad"]:
            break
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        large = _joined(spark, both, both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "u", 2 * n).where("v > u and v != m").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        if 2 * n > BROADCAST_ROWS:
            least = shared_table(spark, least, "least")
        small = _joined(spark, large, least, "hi", 2 * n).where("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionAll(least.select(F.col("m").alias("lo"), "hi"))
        edges = shared_table(spark, small.distinct(), "links")
    roots = edges.select(F.col("lo").alias("id")).distinct().withColumn("root", F.col("id"))
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionAll(roots)


def _joined(spark: SparkSession, rows: DataFrame, least: DataFrame, key: str, n: int) -> DataFrame:
    """Rows with the least neighbour of their key; where it isn't small it's written first, so that a hot key can be split."""
    return rows.join(F.broadcast(least) if n <= BROADCAST_ROWS else shared_table(spark, least, "least"), key)
