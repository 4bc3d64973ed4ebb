"""Connected components of links between 64-bit keys, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedoc.operators.joins import lookup_join

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for links ``a, b``: the smallest node reachable from each node.

    Alternates large-star and small-star steps: every node connects its larger neighbours,
    then its smaller ones, to the smallest node it knows. The number of rounds grows with
    the logarithm of a component's size. The minimum of a node's neighbours is aggregated
    before the shuffle and joined back by `lookup_join`, so a node with very many links is
    split by adaptive execution. Every round is stored, so a lost executor costs no earlier
    round.
    """

    def least(pairs: DataFrame) -> DataFrame:
        """Smallest neighbour of ``a`` in ``pairs``, or ``a`` itself."""
        own = pairs.groupBy("a").agg(F.min("b").alias("least"))
        return own.select("a", F.least("a", "least").alias("least"))

    current = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a != b")
        .distinct(),
        "links",
    )
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node go to the smallest node around it
        large = (
            lookup_join(both, least(both), ["a"])
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .distinct()
        )
        # small star: what is below a node, and the node, go to the smallest below it
        below = least(large)
        small = (
            lookup_join(large, below, ["a"])
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(below.select("a", F.col("least").alias("b")))
            .where("a != b")
            .distinct()
        )
        current = stored(small, "links")
        state = current.agg(
            F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))
        ).first()
        if state == before:
            break
        before = state
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
