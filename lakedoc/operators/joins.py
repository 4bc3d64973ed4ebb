"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    left: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", *, fresh: bool = True
) -> DataFrame:
    """Join ``left`` to a narrow ``lookup`` that has one row per key.

    A sort-merge join whose left partitions adaptive execution splits where a key is
    frequent; only the lookup row of such a key is read again. ``how``: inner, left,
    left_semi or left_anti, which all allow that split.

    A lookup made by ``distinct`` or ``groupBy`` of the keys (``fresh``) already lies as the
    join wants it, so both would run in one stage, and adaptive execution splits no stage
    that holds an aggregate. A rebalance between the two keeps them apart, for one more
    shuffle of the lookup. A table that is read as it is needs none (``fresh=False``).
    """
    side = lookup.hint("rebalance") if fresh else lookup
    return left.join(side.hint("merge"), keys, how)


def is_present(df: DataFrame, name: str) -> DataFrame:
    """One row with the boolean ``name``: whether ``df`` has any row at all."""
    return df.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
