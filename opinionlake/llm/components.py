"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is two grouped minima and joins; hubs are pre-aggregated and their joins split by the adaptive plan. Rounds are cut with reliable
checkpoints. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinionlake.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is hung on the least of the node and its neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    hung = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n"))
    return hung.select(F.col("v").alias("u"), F.least("n", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    hung = down.join(least, F.col("u") == F.col("n"))
    moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v): every node of ``links`` (u, v) that is not its component's least node, with that node. Self links and repeats are ignored."""
    edges = cut_lineage(links.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    before = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(seen) == before:
            return edges
        before = tuple(seen)
