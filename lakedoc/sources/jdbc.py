"""Relational databases through Spark's JDBC source (drivers are the user's)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Partitioning:
    """How to split a large table into parallel reads."""

    column: str
    lower: int | str
    upper: int | str
    partitions: int


def _need(params: dict, key: str, kind: str):
    if not params.get(key):
        raise ValueError(f"'{key}' is required for {kind}")
    return params[key]


def default_schema(kind: str, params: dict) -> str | None:
    """Schema that holds the tables when none is given."""
    if kind in ("mariadb", "mysql"):
        return _need(params, "dbname", kind)
    if kind in ("postgres", "snowflake"):
        return params.get("schema", "public")
    return None


def jdbc_url(kind: str, params: dict) -> str:
    """Connection URL with the defaults of each database kind."""
    host = params.get("host", "localhost")
    if kind == "postgres":
        return f"jdbc:postgresql://{host}:{params.get('port', 5432)}/{params.get('dbname', '')}"
    if kind in ("mariadb", "mysql"):
        database = _need(params, "dbname", kind)
        return f"jdbc:{kind}://{host}:{params.get('port', 3306)}/{database}"
    if kind == "snowflake":
        database = _need(params, "database", kind)
        account = _need(params, "account", kind)
        url = f"jdbc:snowflake://{account}.snowflakecomputing.com/?db={database}"
        url += f"&schema={params.get('schema', 'public')}"
        return url + (f"&warehouse={params['warehouse']}" if params.get("warehouse") else "")
    if kind in ("sqlite", "duckdb"):
        return f"jdbc:{kind}:{_need(params, 'path', kind)}"
    raise ValueError(f"unknown database kind '{kind}'")


def quote(kind: str, name: str) -> str:
    mark = "`" if kind in ("mariadb", "mysql") else '"'
    return mark + name.replace(mark, mark * 2) + mark


def qualified(kind: str, params: dict, table: str) -> str:
    schema = default_schema(kind, params)
    return (quote(kind, schema) + "." if schema else "") + quote(kind, table)


def jdbc_options(
    kind: str, params: dict, table: str, partitioning: Partitioning | None = None
) -> dict[str, str]:
    """Reader options for one table."""
    options = {"url": jdbc_url(kind, params), "dbtable": qualified(kind, params, table)}
    for key in ("user", "password", "driver", "fetchsize"):
        if params.get(key) is not None:
            options[key] = str(params[key])
    if kind == "duckdb" and params["path"].endswith((".db", ".duckdb")):
        options["duckdb.read_only"] = "true"
    if partitioning is not None:
        options |= {
            "partitionColumn": quote(kind, partitioning.column),
            "lowerBound": str(partitioning.lower),
            "upperBound": str(partitioning.upper),
            "numPartitions": str(partitioning.partitions),
        }
    return options


def scan_jdbc(
    spark: SparkSession,
    kind: str,
    params: dict,
    table: str,
    partitioning: Partitioning | None = None,
) -> DataFrame:
    """A database table as a frame; without partitioning it is read by one task."""
    options = jdbc_options(kind, params, table, partitioning)
    return spark.read.format("jdbc").options(**options).load()


def profile_query(kind: str, params: dict, table: str, columns: list[str]) -> str:
    """SQL that lets the database itself count rows, nulls and distinct values.

    Plain JDBC reads push down filters and columns but no aggregates, so a profile of
    a remote table is sent as a query: only one row per column travels. The result
    has the columns ``table_name, column_name, total_count, null_count,
    distinct_count``.
    """
    source = qualified(kind, params, table)

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    parts = []
    for name in columns:
        column = quote(kind, name)
        parts.append(
            f"SELECT {text(table)} AS table_name, {text(name)} AS column_name,"
            f" COUNT(*) AS total_count, COUNT(*) - COUNT({column}) AS null_count,"
            f" COUNT(DISTINCT {column}) AS distinct_count FROM {source}"
        )
    return " UNION ALL ".join(parts)


def profile_jdbc(
    spark: SparkSession, kind: str, params: dict, table: str, columns: list[str]
) -> DataFrame:
    """PROFILE counts of a remote table, computed by the database."""
    options = jdbc_options(kind, params, table)
    options.pop("dbtable")
    options["query"] = profile_query(kind, params, table, columns)
    return spark.read.format("jdbc").options(**options).load()
