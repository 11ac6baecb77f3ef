"""Connected components by alternating star contractions, all of it in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def are_stars(edges: DataFrame) -> bool:
    """Whether each u of the distinct edges (u, v) has one v, and no v is a u: nothing is left to contract."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.filter("up > 1 OR (up = 1 AND down = 1)").agg(F.count(F.lit(1))).first()[0]


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) for the nodes of ``edges`` (a, b) but the smallest of each component: v is that smallest one.

    Every round points each node's larger neighbours, then its smaller ones, at
    the smallest (Kiveris et al., 2014), until all components are stars, which
    edges that are stars at first are without a round; a round's edges
    are written to the shared folder, which cuts the lineage, and replaced by the
    next ones.  The work of a round is one aggregate and one join over the edges;
    paths shrink at least by half, so the rounds grow with the logarithm of a
    class's diameter.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("low"))
        large = both.join(least, F.col("u") == F.col("node")).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "node")
        small = large.join(down, F.col("u") == F.col("node"))
        small = small.select("v", "low").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(down.select(F.col("node").alias("u"), F.col("low").alias("v")))
        after, after_path = written(small.distinct())
        discard(spark, path)
        now, path = after, after_path
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, class_id) for the nodes of ``edges`` (a, b): class_id is the smallest node that is connected."""
    now = stars(edges)
    return now.select(F.col("u").alias("node"), F.col("v").alias("class_id")).union(now.select(F.col("v").alias("node"), F.col("v").alias("class_id")).distinct())
