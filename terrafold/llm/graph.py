"""Connected components by alternating large-star and small-star rounds; no round depends on a group's size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.base import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, label): of every node of the edges (a, b) the smallest id of its component; a node of no edge but to itself is absent."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        near = Window.partitionBy("u")
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.select("u", "v", F.least(F.min("v").over(near), F.col("u")).alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.select("u", "v", F.min("v").over(near).alias("m"))
        small = low.select("u", F.col("m").alias("v")).unionAll(low.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
        before = now
