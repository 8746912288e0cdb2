"""Connected components of a table of links, by repeated contraction. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node and root for every node of links (a, b: long); nodes of one component share a root.

    In a round every node goes over to its least neighbour, if that is less, and links are redrawn between where their
    ends went. At least half of the nodes that still have links go over, so rounds are few; a star takes one.
    """
    links = materialize(links.where("a is not null and b is not null").select("a", "b").distinct(), "links")
    labels = None
    while True:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = materialize(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("root")), "moves")
        if labels is None:
            labels = moves
        else:
            step = moves.withColumnsRenamed({"node": "_n", "root": "_r"})
            labels = materialize(labels.join(step, labels["root"] == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "labels")
        to_a, to_b = moves.select(F.col("node").alias("a"), F.col("root").alias("_a")), moves.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        before = links
        links = materialize(links.join(to_a, "a").join(to_b, "b").where("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
        discard(before)
        if links.isEmpty():
            return labels
