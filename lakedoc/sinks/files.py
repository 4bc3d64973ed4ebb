"""File sinks: catalog records, documents, documentation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(catalog: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Catalog records as JSON lines."""
    catalog.write.mode(mode).json(path)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents as text: one folder per document, its lines in order.

    The global sort ranges over position within a document, so one very large
    document is written by many tasks; its part files read in name order are the text.
    """
    ordered = lines.orderBy("doc_name", "section", "part", "ordinal")
    ordered.select("doc_name", "line").write.mode(mode).partitionBy("doc_name").text(path)


def write_docs(filled: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """DOCS of the files that changed, one folder per file; other files stay as they are.

    Rows are spread by range over file and key, so a file with very many entries is
    written by several tasks.
    """
    from ..operators.joins import lookup_join

    changed = filled.filter("changed").select("file_path").distinct()
    rows = lookup_join(filled, changed, ["file_path"], "left_semi")
    spread = rows.repartitionByRange(
        F.col("file_path"), F.col("model_name"), F.col("column_name"), F.col("doc_key")
    )
    writer = spread.drop("changed").write.mode(mode).format(fmt).partitionBy("file_path")
    writer.option("partitionOverwriteMode", "dynamic").save(path)
