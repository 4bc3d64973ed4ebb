"""Prompt texts built from catalog rows; one expression per kind of prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fill(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def column_prompt(table: Column, column: Column, data_type: Column, profile: Column) -> Column:
    return _fill(
        "Describe a database column in fewer than 15 words.\nTable: ", table,
        "\nColumn: ", column, "\nType: ", data_type, "\nProfile:\n", profile,
        "\nMention uniqueness, few distinct values (category) and many nulls (optional).",
    )


def table_prompt(table: Column, columns: Column) -> Column:
    return _fill(
        "Say in one or two sentences what the table ", table,
        " holds. Its columns are: ", columns, ".",
    )


def view_prompt(view: Column, definition: Column) -> Column:
    return _fill(
        "Say in one or two sentences what the view ", view,
        " shows. Its definition is:\n", definition,
    )


def model_prompt(model: Column, sql: Column) -> Column:
    return _fill(
        "Say in one or two sentences what the model ", model,
        " produces. Its SQL is:\n", sql,
    )


def lineage_prompt(model: Column, sql: Column) -> Column:
    return _fill(
        "Draw the direct parents of the model ", model,
        " as a top-down flow chart, from its ref and source calls:\n", sql,
    )


def column_metadata_prompt(model: Column, column: Column, data_type: Column, sql: Column) -> Column:
    return _fill(
        "Document the column ", column, " (", data_type, ") of the model ", model,
        " as YAML with description, meta.pii, tags and tests. Its SQL is:\n", sql,
    )


def drift_prompt(node: Column, column: Column, description: Column, profile: Column) -> Column:
    return _fill(
        "Answer MATCH or DRIFT: does the data contradict the description?\nColumn: ",
        node, ".", column, "\nDescription: ", description, "\nProfile:\n", profile,
    )
