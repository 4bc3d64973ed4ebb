"""Registration of queries, table access and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakedoc.functions.ratios import TIES_UP

# Columns of the given tables with their Spark type names, in order.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string,"
    " o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
    " value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables below one folder, read lazily by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def all(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` as a query, with its SQL if there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def names_of(table: str) -> list[str]:
    return [part.split()[0] for part in TABLES[table].split(", ")]


def types_of(table: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in TABLES[table].split(", ")]


def ratio_sql(part: str, total: str) -> str:
    """Share in hundredths, with ties as in `lakedoc.functions.ratios`."""
    ties = ", ".join(map(str, TIES_UP))
    safe = f"nullif({total}, 0)"
    whole, rest = f"((100 * {part}) // {safe})", f"((100 * {part}) % {safe})"
    up = f"(2 * {rest} > {total} OR (2 * {rest} = {total} AND {whole} IN ({ties})))"
    return (
        f"CASE WHEN {total} = 0 THEN 0.0::DOUBLE"
        f" ELSE ({whole} + CASE WHEN {up} THEN 1 ELSE 0 END) / 100.0::DOUBLE END"
    )


def profile_sql(columns: list[tuple[str, str, str]], extra: str = "") -> str:
    """Profile of ``(table name, column, FROM item)`` as a parenthesised query."""
    counts = " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name,"
        f" count(*)::BIGINT AS total_count, (count(*) - count({column}))::BIGINT AS null_count,"
        f" count(DISTINCT {column})::BIGINT AS distinct_count{extra.format(c=column)}"
        f" FROM {source}"
        for table, column, source in columns
    )
    return (
        f"(SELECT *, {ratio_sql('null_count', 'total_count')} AS null_ratio,"
        " (distinct_count = total_count AND null_count = 0) AS is_unique,"
        " CASE WHEN total_count = 0 THEN 'empty' ELSE 'ok' END AS profile_status"
        f" FROM ({counts}) counts)"
    )


def table_profile_sql(*tables: str) -> str:
    return profile_sql([(t, c, t) for t in tables for c in names_of(t)])


BLANK_SQL = "({0} IS NULL OR trim({0}) = '')"


def blank_sql(expression: str) -> str:
    return BLANK_SQL.format(expression)
