"""Column profiles: rows, nulls, distinct values and uniqueness of every column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import key_of, quoted, text_key_of
from ..functions.ratios import null_ratio_sql
from ..schemas import local_frame
from .longform import (
    COLUMNS_PER_SCAN,
    column_slot,
    column_type,
    countable,
    long_values,
    union_all,
    value_counts,
)

_COUNTS = "slot int, rows long, nulls long, distincts long"
_EXTREMES = ["min_value", "max_value", "avg_value"]
_NUMERIC = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)

# How far below the rows, in standard deviations, a sketch may lie for a recount.
DEVIATIONS = 6


def profile_column(df: DataFrame, column: str, table_name: str = "") -> DataFrame:
    """Profile of one column; see `profile_table`."""
    return profile_table(df, table_name, [column])


def profile_table(
    df: DataFrame,
    table_name: str,
    columns: list[str] | None = None,
    *,
    extended: bool = False,
    one_scan: bool = False,
    approx: float | None = None,
    columns_per_scan: int = COLUMNS_PER_SCAN,
) -> DataFrame:
    """PROFILE rows for ``columns`` (default: all) of ``df``, in one action.

    Columns that do not exist or whose values cannot be compared get NULL statistics
    and the status ``failed``; the others are still profiled. ``extended`` adds
    ``min_value, max_value, avg_value``. ``one_scan`` reads row formats once.
    ``approx`` (relative standard deviation, e.g. 0.05) replaces the exact distinct
    counts by sketches, except for columns that may be unique: those are recounted
    exactly. A unique column is missed only where its sketch falls six standard
    deviations short, which no lake has columns enough to see. It runs the sketching job
    when it is called, to learn which columns those are.
    """
    return profile_database(
        {table_name: df},
        {table_name: columns} if columns is not None else None,
        extended=extended,
        one_scan=one_scan,
        approx=approx,
        columns_per_scan=columns_per_scan,
    )


def profile_columns(df: DataFrame, table_name: str, documented: list[str]) -> DataFrame:
    """Profile of a derived column list, e.g. the columns that have documentation."""
    return profile_table(df, table_name, documented)


def profile_database(
    tables: dict[str, DataFrame],
    columns: dict[str, list[str]] | None = None,
    *,
    extended: bool = False,
    one_scan: bool = False,
    approx: float | None = None,
    columns_per_scan: int = COLUMNS_PER_SCAN,
) -> DataFrame:
    """PROFILE rows of all ``tables`` as one plan with one final aggregation.

    The plan grows with the number of tables; profile a lake of thousands in
    batches (`lakedoc.plans.catalog.profile_to_path`).
    """
    wanted = {
        name: list(dict.fromkeys((columns or {}).get(name, df.columns)))
        for name, df in tables.items()
    }
    pairs = [(n, c) for n, cs in wanted.items() for c in cs]
    usable = {i: p for i, p in enumerate(pairs) if countable(tables[p[0]], p[1])}
    spark = next(iter(tables.values())).sparkSession
    inventory = local_frame(
        spark,
        [(i, n, c, i in usable) for i, (n, c) in enumerate(pairs)],
        "slot int, table_name string, column_name string, usable boolean",
    )
    key = text_key_of if one_scan else key_of
    slots = [column_slot(s, tables[n], c, key) for s, (n, c) in usable.items()]
    if not slots:
        counts = local_frame(spark, [], _COUNTS)
    elif approx is None:
        counts = _exact_counts(long_values(slots, columns_per_scan))
    else:
        counts = _approx_counts(spark, tables, usable, slots, approx, columns_per_scan)
    # One row per column: the broadcast is bounded by the schemas. Starting from the
    # inventory keeps empty tables and failed columns in the result.
    stats = inventory.join(F.broadcast(counts), "slot", "left")
    if extended:
        extremes = _extremes(spark, tables, usable, columns_per_scan)
        stats = stats.join(F.broadcast(extremes), "slot", "left")
    found = stats.selectExpr(
        "table_name",
        "column_name",
        "usable",
        *[
            f"CASE WHEN usable THEN coalesce({c}, 0L) END AS {n}"
            for c, n in (
                ("rows", "total_count"),
                ("nulls", "null_count"),
                ("distincts", "distinct_count"),
            )
        ],
        *(_EXTREMES if extended else []),
    )
    return found.selectExpr(
        "table_name",
        "column_name",
        "total_count",
        "null_count",
        "distinct_count",
        f"{null_ratio_sql('null_count', 'total_count')} AS null_ratio",
        "distinct_count = total_count AND null_count = 0 AS is_unique",
        "CASE WHEN NOT usable THEN 'failed' WHEN total_count = 0 THEN 'empty' ELSE 'ok' END"
        " AS profile_status",
        *(_EXTREMES if extended else []),
    )


def _exact_counts(classes: dict[str, DataFrame]) -> DataFrame:
    return value_counts(classes).groupBy("slot").agg(
        F.sum("n").alias("rows"),
        F.expr("sum(CASE WHEN is_null THEN n ELSE 0L END)").alias("nulls"),
        F.expr("count_if(NOT is_null)").alias("distincts"),
    )


def _by_table(
    usable: dict[int, tuple[str, str]], columns_per_scan: int
) -> list[tuple[str, list[tuple[int, str]]]]:
    """Slots and columns by table, very wide tables in chunks."""
    grouped: dict[str, list[tuple[int, str]]] = {}
    for slot, (table, column) in usable.items():
        grouped.setdefault(table, []).append((slot, column))
    return [
        (table, members[start : start + columns_per_scan])
        for table, members in grouped.items()
        for start in range(0, len(members), columns_per_scan)
    ]


def _unfold(row: DataFrame, rows: list[list[str]], names: str) -> DataFrame:
    """Turn one wide row into one row per column: ``rows`` are lists of SQL texts."""
    values = ", ".join(", ".join(row) for row in rows)
    return row.selectExpr(f"stack({len(rows)}, {values}) AS ({names})")


def _approx_counts(spark, tables, usable, slots, rsd: float, columns_per_scan: int) -> DataFrame:
    keys = {s.id: s.key for s in slots}
    frames = []
    for name, members in _by_table(usable, columns_per_scan):
        row = tables[name].selectExpr(
            "count(1) AS total",
            *[f"count({quoted(c)}) AS f{s}" for s, c in members],
            *[f"approx_count_distinct({keys[s]}, {rsd}D) AS d{s}" for s, _ in members],
        )
        rows = [[str(s), "total", f"total - f{s}", f"least(d{s}, f{s})"] for s, _ in members]
        frames.append(_unfold(row, rows, "slot, rows, nulls, distincts"))
    # One row per column: this is collected (it is bounded by the schemas) so that the
    # exact pass reads only the few columns that need it.
    sketch = [tuple(r) for r in union_all(frames).collect()]
    # May be unique: no null, and the sketch is within DEVIATIONS of all rows.
    suspects = {
        slot: (slot, rows, nulls)
        for slot, rows, nulls, distincts in sketch
        if rows and not nulls and distincts >= rows * (1 - DEVIATIONS * rsd)
    }
    counts = local_frame(spark, [r for r in sketch if r[0] not in suspects], _COUNTS)
    if not suspects:
        return counts
    checked = [s for s in slots if s.id in suspects]
    return counts.unionByName(_exact_counts(long_values(checked, columns_per_scan)))


def _extremes(spark, tables, usable, columns_per_scan: int) -> DataFrame:
    """``slot, min_value, max_value, avg_value`` of the orderable columns, one scan."""
    frames = [
        local_frame(
            spark, [], "slot int, min_value string, max_value string, avg_value double"
        )
    ]
    for name, members in _by_table(usable, columns_per_scan):
        kinds = {s: column_type(tables[name], c) for s, c in members}
        members = [(s, c) for s, c in members if _orderable(kinds[s])]
        aggregates, rows = [], []
        for s, c in members:
            numeric = isinstance(kinds[s], _NUMERIC)
            aggregates += [f"min({quoted(c)}) AS lo{s}", f"max({quoted(c)}) AS hi{s}"]
            if numeric:
                aggregates.append(f"avg(CAST({quoted(c)} AS DOUBLE)) AS av{s}")
            mean = f"av{s}" if numeric else "CAST(NULL AS DOUBLE)"
            rows.append([str(s), f"CAST(lo{s} AS STRING)", f"CAST(hi{s} AS STRING)", mean])
        if members:
            row = tables[name].selectExpr(*aggregates)
            frames.append(_unfold(row, rows, ", ".join(["slot", *_EXTREMES])))
    return union_all(frames)


def _orderable(data_type: T.DataType) -> bool:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return not isinstance(data_type, nested) and data_type.simpleString() != "interval"


def candidate_keys(profile: DataFrame) -> DataFrame:
    """Columns that are unique and never null in a table that has rows."""
    return profile.filter(F.col("is_unique") & (F.col("total_count") > 0)).select(
        "table_name", "column_name"
    )


def is_composite_key(df: DataFrame, columns: list[str], table_name: str = "") -> DataFrame:
    """Whether the columns together identify every row; a null disqualifies."""
    keys = [key_of(quoted(c), column_type(df, c))[1] for c in columns]
    names = [f"k{i}" for i in range(len(keys))]
    groups = (
        df.selectExpr(*[f"{key} AS {n}" for key, n in zip(keys, names)])
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("n", " OR ".join(f"{n} IS NULL" for n in names) + " AS has_null")
    )
    return groups.agg(
        F.expr("coalesce(sum(n), 0L)").alias("total_count"),
        F.expr("coalesce(sum(CASE WHEN has_null THEN n END), 0L)").alias("null_count"),
        F.expr("count_if(NOT has_null)").alias("distinct_count"),
    ).select(
        F.lit(table_name).alias("table_name"),
        F.lit(", ".join(columns)).alias("column_names"),
        "total_count",
        "null_count",
        "distinct_count",
        F.expr("distinct_count = total_count AND null_count = 0").alias("is_key"),
    )
