"""The Spark catalog as a source: tables, views and their text, columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import list_all_columns


def _quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def _details(spark: SparkSession, schema: str) -> DataFrame:
    # One catalog command describes every table and view of the schema.
    return spark.sql(f"SHOW TABLE EXTENDED IN {_quoted(schema)} LIKE '*'").filter(~F.col("isTemporary"))


def list_tables(spark: SparkSession, schema: str) -> DataFrame:
    """``table_name`` of the base tables of a schema; views are excluded."""
    kind = F.regexp_extract("information", r"(?m)^Type: (\w+)", 1)
    return _details(spark, schema).filter(kind != "VIEW").select(
        F.col("tableName").alias("table_name")
    )


def list_views(spark: SparkSession, schema: str) -> DataFrame:
    """VIEWS of a schema with their SQL text."""
    text = F.regexp_extract("information", r"(?s)\nView Text: (.*?)\nView Original Text: ", 1)
    kind = F.regexp_extract("information", r"(?m)^Type: (\w+)", 1)
    return _details(spark, schema).filter(kind == "VIEW").select(
        F.col("tableName").alias("view_name"), text.alias("definition")
    )


def read_tables(spark: SparkSession, schema: str, names: list[str]) -> dict[str, DataFrame]:
    """Lazy frames of catalog tables by name, as the profile operators take them."""
    return {n: spark.table(f"{_quoted(schema)}.`{n.replace('`', '``')}`") for n in names}


def list_catalog_columns(spark: SparkSession, schema: str, names: list[str]) -> DataFrame:
    """COLUMNS of catalog tables, with their comments as descriptions."""
    return list_all_columns(read_tables(spark, schema, names))
