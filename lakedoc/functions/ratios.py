"""Null ratio and uniqueness from exact integer counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A ratio that lies exactly half way between two hundredths is rounded by the value
# of its nearest binary double (0.145 -> 0.14 but 0.155 -> 0.16 and 0.125 -> 0.12).
# There are only 100 such ties, k + 1/2 hundredths; these are the k that go up.
TIES_UP = [k for k in range(100) if round((2 * k + 1) / 200, 2) * 100 > k + 0.5]


def null_ratio_sql(nulls: str, total: str) -> str:
    """SQL of ``nulls / total`` rounded to two digits; 0.0 for an empty table.

    Works on the integer counts, so the result does not depend on how an engine
    rounds doubles.
    """
    safe = f"nullif({total}, 0)"  # ANSI mode raises on a zero divisor
    down, rest = f"(100 * {nulls}) div {safe}", f"(100 * {nulls}) % {safe}"
    tie_up = f"2 * ({rest}) = {total} AND {down} IN ({', '.join(map(str, TIES_UP))})"
    up = f"CASE WHEN 2 * ({rest}) > {total} OR ({tie_up}) THEN 1 ELSE 0 END"
    return f"CASE WHEN {total} = 0 THEN 0.0D ELSE ({down} + {up}) / 100.0D END"


def null_ratio(nulls: str, total: str) -> Column:
    """`null_ratio_sql` of two columns given by name."""
    return F.expr(null_ratio_sql(nulls, total))
