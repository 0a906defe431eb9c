"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(doc, class) for every end of a link (a, b): class is the smallest id that can be reached.

    Large-star and small-star rounds (Kiveris et al., 2014): every node hands its larger, then its
    smaller neighbours to its smallest neighbour, until each class is a star around its smallest
    node. A round is two joins on the node; its minimum is combined map-side, so a node with very
    many neighbours is no burden. Each round is written down before the next one reads it.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("class")).unionByName(
        edges.select(F.col("v").alias("doc"), F.col("v").alias("class")).distinct()
    )
