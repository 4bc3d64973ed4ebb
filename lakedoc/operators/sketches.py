"""Profiles kept as sketches that can be merged: a grown table is not read again.

A profile with sketched counts is good for one reading. Here the sketches themselves are
rows, one per table, part (a partition of the table) and column: a count sketch (HLL) of
the distinct values and, for numbers, a quantile sketch (KLL). Rows of several parts or
tables merge into one (`merge_sketches`) with the same error as if all had been read
together, and give a profile (`profile_of_sketches`) at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import key_of, quoted
from ..functions.ratios import null_ratio
from .longform import COLUMNS_PER_SCAN, column_type, countable, union_all

LG_K = 12  # of a count sketch: 2**LG_K registers, a byte each
KLL_K = 200  # of a quantile sketch: about 1.3 % of the rank
DEVIATIONS = 4  # half width of the stated bounds, in standard deviations of the sketch

_NUMBERS = (T.NumericType,)

SKETCHES = (
    "table_name string, part string, column_name string, rows long, nulls long,"
    " counts binary, quantiles binary, lg_k int"
)


def deviation(lg_k: int) -> float:
    """Relative standard deviation of a count sketch."""
    return 1.04 / 2 ** (lg_k / 2)


def sketch_parts(
    df: DataFrame,
    table_name: str,
    part: str | Column,
    *,
    lg_k: int = LG_K,
    kll_k: int = KLL_K,
    columns_per_scan: int = COLUMNS_PER_SCAN,
) -> DataFrame:
    """SKETCHES of every part and column, in one scan (very wide tables: in chunks).

    ``part`` is a column of ``df`` or an expression, as text in the result; null is a part
    of its own. Columns whose values cannot be compared have no row. Values are sketched by
    their grouping key, as `profile_table` counts them.
    """
    column = F.col(part) if isinstance(part, str) else part
    rows = df.withColumn("__part", column.cast("string"))
    names = [c for c in df.columns if countable(df, c)]
    frames = []
    for start in range(0, len(names), columns_per_scan):
        chunk = names[start : start + columns_per_scan]
        aggregates, stacked = [F.expr("count(1)").alias("__rows")], []
        for i, name in enumerate(chunk):
            kind, value = column_type(df, name), quoted(name)
            key = key_of(value, kind)[1]
            hashed = f"CASE WHEN {value} IS NOT NULL THEN xxhash64({key}) END"
            aggregates += [
                F.expr(f"count({value})").alias(f"__f{i}"),
                F.expr(f"hll_sketch_agg({hashed}, {lg_k})").alias(f"__h{i}"),
            ]
            quantiles = "CAST(NULL AS BINARY)"
            if isinstance(kind, _NUMBERS):
                number = f"CAST({value} AS DOUBLE)"
                finite = f"CASE WHEN NOT isnan({number}) THEN {number} END"
                aggregates.append(F.expr(f"kll_sketch_agg_double({finite}, {kll_k})").alias(f"__q{i}"))
                quantiles = f"__q{i}"
            stacked.append(f"'{_escaped(name)}', __rows - __f{i}, __h{i}, {quantiles}")
        grouped = rows.groupBy("__part").agg(*aggregates)
        frames.append(
            grouped.selectExpr(
                f"'{_escaped(table_name)}' AS table_name",
                "__part AS part",
                "__rows AS rows",
                f"stack({len(chunk)}, {', '.join(stacked)}) AS (column_name, nulls, counts, quantiles)",
            )
        )
    order = ["table_name", "part", "column_name", "rows", "nulls", "counts", "quantiles"]
    if not frames:
        return df.sparkSession.createDataFrame([], SKETCHES)
    return union_all(frames).select(*order, F.lit(lg_k).alias("lg_k"))


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per table and column (or per ``by`` and column) of what the parts hold together."""
    keys = [*(by if by is not None else ["table_name"]), "column_name"]
    return sketches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.expr("hll_union_agg(counts, true)").alias("counts"),
        F.expr("kll_merge_agg_double(quantiles)").alias("quantiles"),
        F.min("lg_k").alias("lg_k"),  # a union is as coarse as its coarsest part
    )


def profile_of_sketches(merged: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """PROFILE-like rows of merged sketches.

    ``total_count, null_count, null_ratio`` are exact. ``distinct_count`` is an estimate,
    never above the rows that have a value; the true one lies between ``distinct_low`` and
    ``distinct_high`` (``deviations`` standard deviations of the sketch). ``is_unique`` is
    true, false, or null where the bounds leave it open. ``lower_quartile, median,
    upper_quartile`` are of numbers only.
    """
    spent = ("rows", "nulls", "counts", "quantiles", "lg_k")
    keys = [c for c in merged.columns if c not in spent]  # names, and the number of parts
    filled = F.col("rows") - F.col("nulls")
    width = F.lit(deviations * 1.04) / F.pow(F.lit(2.0), F.col("lg_k") / 2)
    guess = F.expr("hll_sketch_estimate(counts)").cast("double")
    clipped = lambda value: F.least(F.greatest(value, F.lit(0.0)), filled.cast("double"))
    low = F.ceil(clipped(guess / (1 + width)))
    # small counts are exact up to rounding in the sketch
    high = F.floor(clipped(guess / (1 - width) + 0.5))
    some = F.expr("CASE WHEN kll_sketch_get_n_double(quantiles) > 0 THEN quantiles END")
    quantile = lambda q: F.call_function("kll_sketch_get_quantile_double", some, F.lit(q))
    counted = merged.select(
        *keys,
        F.col("rows").alias("total_count"),
        F.col("nulls").alias("null_count"),
        F.round(clipped(guess)).cast("long").alias("distinct_count"),
        low.cast("long").alias("distinct_low"),
        high.cast("long").alias("distinct_high"),
        quantile(0.25).alias("lower_quartile"),
        quantile(0.5).alias("median"),
        quantile(0.75).alias("upper_quartile"),
    )
    unique = F.when(
        (F.col("null_count") > 0) | (F.col("distinct_high") < F.col("total_count")), F.lit(False)
    ).when((F.col("null_count") == 0) & (F.col("distinct_low") >= F.col("total_count")), F.lit(True))
    return counted.withColumn("null_ratio", null_ratio("null_count", "total_count")).withColumn(
        "is_unique", unique
    )
