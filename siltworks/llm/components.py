"""Connected components of links, by alternating stars: every pass is a join and two aggregates on narrow rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.frames import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (x, y) that is not the smallest of its component.

    Links are rows of two long numbers, read more than once; loops and repeated links do no harm. A node with many
    neighbours is aggregated before it is shuffled, and the join that hands its smallest neighbour round is one that Spark
    splits. Passes end when the links are stars: every node stands on one side only, and the larger one in one link.
    """
    edges = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u > v")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "stars")
        sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        sides = sides.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        sides = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not sides.agg(F.max((F.col("up") + F.col("down") > 1).cast("int"))).first()[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
