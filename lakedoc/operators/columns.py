"""Column inventories: from schemas and from metadata extracts of many databases.

An extract carries a ``source`` column (the database it was taken from), which is
part of every join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import local_frame
from .longform import union_all

_TABLE = ["source", "table_schema", "table_name"]
_CONSTRAINT = ["source", "table_schema", "constraint_name"]


def list_columns(df: DataFrame, table_name: str) -> DataFrame:
    """COLUMNS rows of a frame, in source order, from its schema alone."""
    return list_all_columns({table_name: df})


def list_all_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """COLUMNS rows of several frames, as one local relation."""
    rows = [
        (
            name,
            field.name,
            position,
            field.dataType.simpleString(),
            field.nullable,
            False,
            field.metadata.get("comment", ""),
        )
        for name, df in tables.items()
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return local_frame(next(iter(tables.values())).sparkSession, rows, "COLUMNS")


def base_tables(tables: DataFrame, schema: str | None = None) -> DataFrame:
    """Base tables of an extract, views excluded; optionally of one schema."""
    kept = tables.filter(F.col("table_type") == "BASE TABLE")
    if schema is not None:
        kept = kept.filter(F.col("table_schema") == schema)
    return kept.select(*_TABLE)


def columns_with_pk(
    columns: DataFrame, key_usage: DataFrame, constraints: DataFrame
) -> DataFrame:
    """COLUMNS rows of an extract with ``is_pk``, one row per column.

    A column may take part in several keys; the primary key columns are therefore
    made distinct before the join. A constraint name may occur on several tables of a
    schema, so the table is part of the key where the constraints name it.
    """
    primary = constraints.filter(F.col("constraint_type") == "PRIMARY KEY")
    key = constraint_key(constraints)
    pk = key_usage.join(primary.select(*key).distinct().hint("merge"), key, "left_semi")
    return _flagged(columns, pk.select(*_TABLE, "column_name"))


def constraint_key(constraints: DataFrame) -> list[str]:
    """Columns that tell a constraint: with its table, if the extract has it."""
    return [*_CONSTRAINT, *(["table_name"] if "table_name" in constraints.columns else [])]


def mark_pk(columns: DataFrame, pk_names: DataFrame) -> DataFrame:
    """COLUMNS rows of an extract, flagged by a plain list of primary key columns."""
    return _flagged(columns, pk_names.select(*_TABLE, "column_name"))


def _flagged(columns: DataFrame, pk: DataFrame) -> DataFrame:
    flags = pk.distinct().withColumn("in_key", F.lit(True))
    return columns.join(flags, [*_TABLE, "column_name"], "left").select(
        *_TABLE,
        "column_name",
        F.col("ordinal_position").cast("int").alias("ordinal"),
        "data_type",
        (F.col("is_nullable") == "YES").alias("is_nullable"),
        F.coalesce("in_key", F.lit(False)).alias("is_pk"),
        F.lit("").alias("description"),
    )


def columns_from_describe(described: DataFrame) -> DataFrame:
    """COLUMNS rows from a describe listing ``table_name, ordinal, name, type, null, key``.

    ``null`` is YES or NO; ``key`` is PRI for the columns of the primary key.
    """
    return described.select(
        "table_name",
        F.col("name").alias("column_name"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("type").alias("data_type"),
        (F.upper("null") == "YES").alias("is_nullable"),
        F.coalesce(F.upper("key") == "PRI", F.lit(False)).alias("is_pk"),
        F.lit("").alias("description"),
    )


def views_from_extract(views: DataFrame, schema: str | None = None) -> DataFrame:
    """VIEWS rows from an extract ``table_schema, table_name, view_definition``."""
    if schema is not None:
        views = views.filter(F.col("table_schema") == schema)
    return views.select(
        F.col("table_name").alias("view_name"),
        F.coalesce("view_definition", F.lit("")).alias("definition"),
    )


def columns_from_pragma(table_info: DataFrame) -> DataFrame:
    """COLUMNS rows from the layout ``cid, name, type, notnull, dflt_value, pk``."""
    return table_info.select(
        "table_name",
        F.col("name").alias("column_name"),
        (F.col("cid") + 1).cast("int").alias("ordinal"),
        F.col("type").alias("data_type"),
        (F.col("notnull") == 0).alias("is_nullable"),
        (F.col("pk") > 0).alias("is_pk"),
        F.lit("").alias("description"),
    )


def column_list(columns: DataFrame) -> DataFrame:
    """All column names of every table, comma-separated in source order.

    Names are gathered as a set: an inventory that was landed several times does not
    grow the groups, so a group is as large as its table is wide.
    """
    names = F.transform(
        F.array_sort(F.collect_set(F.struct("ordinal", "column_name"))),
        lambda c: c["column_name"],
    )
    place = [c for c in ("source", "table_schema") if c in columns.columns]
    return columns.groupBy(*place, "table_name").agg(
        F.array_join(names, ", ").alias("column_list")
    )


def catalog_summary(columns: DataFrame, views: DataFrame, fks: DataFrame) -> DataFrame:
    """One row with the numbers of tables, columns, views and foreign keys."""
    counted = union_all(
        [
            columns.groupBy(*[c for c in _TABLE if c in columns.columns])
            .agg(F.count(F.lit(1)).alias("columns"))
            .select(F.lit(1).alias("tables"), "columns", *_zeros("views", "fks")),
            views.select(*_zeros("tables", "columns"), F.lit(1).alias("views"), *_zeros("fks")),
            fks.select(*_zeros("tables", "columns", "views"), F.lit(1).alias("fks")),
        ]
    )
    totals = {"tables": "tables", "columns": "columns", "views": "views", "fks": "foreign_keys"}
    return counted.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in totals.items()]
    )


def _zeros(*names: str) -> list[Column]:
    return [F.lit(0).alias(n) for n in names]


