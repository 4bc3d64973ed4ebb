"""Comments on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _name(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def apply_comments(
    spark: SparkSession, schema: str, summaries: DataFrame, columns: DataFrame
) -> int:
    """Store summaries (table_name, summary) and descriptions as catalog comments.

    Comments are catalog commands, which only the driver can issue; the rows are
    streamed to it one partition at a time. Returns the number of comments.
    """
    done = 0
    for row in summaries.filter("summary <> ''").toLocalIterator():
        target = f"{_name(schema)}.{_name(row.table_name)}"
        spark.sql(f"COMMENT ON TABLE {target} IS {_text(row.summary)}")
        done += 1
    for row in columns.filter("description <> ''").toLocalIterator():
        target = f"{_name(schema)}.{_name(row.table_name)}"
        column = _name(row.column_name)
        spark.sql(f"ALTER TABLE {target} ALTER COLUMN {column} COMMENT {_text(row.description)}")
        done += 1
    return done


def with_comments(df: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """The frame with column comments in its schema, kept when written to files."""
    for name, text in descriptions.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "comment": text})
    return df
