"""Connected components of a table of links, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _low(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b) that is not the smallest
    of its component; ``root`` is that smallest node.

    Alternates large-star (every larger neighbour is tied to the smallest
    neighbour) and small-star (every smaller one is), which flattens any
    component in a logarithmic number of rounds. Smallest neighbours are map-side minima, so
    a node with very many links costs one row per task.
    """
    links = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct(), "links")
    last = None
    while True:
        mark = links.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("h")).first()
        if mark == last or mark.n == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # large-star's links point from the larger to the smaller node
        large = saved(large, "links")
        down = _low(large)
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tied = down.select("a", F.col("m").alias("b"))
        links = saved(small.unionByName(tied).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a <> b").distinct(), "links")
