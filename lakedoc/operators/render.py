"""Catalog records and documents.

Documents are LINES: one row per line with its position. Nothing here gathers a
document into one value, so a catalog of any size renders as an ordinary parallel
job; `lakedoc.sinks.files.write_lines` puts the lines in order and writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions.text import escape_quotes, table_summary
from ..schemas import local_frame
from .joins import is_present
from .longform import union_all

_LAST = 1 << 40  # ordinal of the line that closes a part
_LINES = ["doc_name", "section", "part", "ordinal", "line"]


def _fixed(df: DataFrame, doc: str, section: int, lines: list[str]) -> DataFrame:
    rows = [(doc, section, "", i, line) for i, line in enumerate(lines)]
    return local_frame(df.sparkSession, rows, "LINES")


def _block(doc: str, section: int, part: Column, lines: list[Column | str]) -> Column:
    """Array of line structs that belong to one row, numbered from 0."""
    return F.array(
        *[
            F.struct(
                F.lit(doc).alias("doc_name"),
                F.lit(section).alias("section"),
                part.alias("part"),
                F.lit(i).cast("long").alias("ordinal"),
                (F.lit(x) if isinstance(x, str) else x).alias("line"),
            )
            for i, x in enumerate(lines)
        ]
    )


def _either(
    present: DataFrame, doc: str, section: int, full: list[str], empty: list[str]
) -> DataFrame:
    """Fixed lines that depend on whether a section has content."""
    blank = F.lit("")
    chosen = F.when(F.col("present"), _block(doc, section, blank, full) if full else None)
    none = _block(doc, section, blank, empty) if empty else F.lit(None)
    return present.select(F.inline(chosen.otherwise(none)))


def _line(doc: str, section: int, part: Column, ordinal: Column, line: Column) -> list[Column]:
    values = (F.lit(doc), F.lit(section), part, ordinal.cast("long"), line)
    return [v.alias(n) for v, n in zip(values, _LINES)]


def _erd(fks: DataFrame, doc: str, section: int) -> list[DataFrame]:
    names = ("source_table", "target_table", "source_column", "target_column")
    relation = F.format_string(fmt.ERD_FORMAT, *map(F.col, names))
    present = is_present(fks, "present")
    opening = [fmt.FENCE + "mermaid", fmt.ERD_HEADER]
    return [
        _either(present, doc, section, opening, [fmt.NO_FKS]),
        fks.select(*_line(doc, section + 1, relation, F.lit(0), relation)),
        _either(present, doc, section + 2, [fmt.FENCE], []),
    ]


def erd_text(fks: DataFrame, doc_name: str = "erd") -> DataFrame:
    """LINES of the entity relationship diagram, relations in text order."""
    return union_all(_erd(fks, doc_name, 0))


def catalog_markdown(
    columns: DataFrame, summaries: DataFrame, views: DataFrame, fks: DataFrame, name: str
) -> DataFrame:
    """LINES of the catalog document of a database.

    ``columns``: table_name, column_name, ordinal, data_type, description;
    ``summaries``: table_name, summary; ``views``: view_name, definition, summary.
    """
    doc = name
    view, table = F.col("view_name"), F.col("table_name")
    note = F.coalesce(F.col("summary"), F.lit(fmt.NO_SUMMARY))
    quoted = F.format_string(fmt.QUOTE_FORMAT, note)
    view_block = _block(
        doc, 21, view,
        [F.format_string(fmt.VIEW_HEADING, view), "", fmt.SUMMARY_HEADING, quoted, "",
         fmt.SQL_HEADING, fmt.FENCE + "sql",
         F.coalesce(F.col("definition"), F.lit(fmt.NOT_AVAILABLE)), fmt.FENCE, ""],
    )
    table_block = _block(
        doc, 31, table,
        [F.format_string(fmt.TABLE_HEADING, table), "", fmt.SUMMARY_HEADING, quoted, "",
         fmt.COLUMN_TABLE_HEADER, fmt.COLUMN_TABLE_RULE],
    )
    tables = columns.select("table_name").distinct().join(
        summaries.select("table_name", "summary"), "table_name", "left"
    )
    row = F.format_string(
        fmt.COLUMN_ROW_FORMAT, F.col("column_name"), F.col("data_type"), F.col("description")
    )
    views_present, tables_present = is_present(views, "present"), is_present(columns, "present")
    return union_all(
        [
            _fixed(columns, doc, 0, [fmt.CATALOG_TITLE % name, "", fmt.ERD_HEADING, ""]),
            *_erd(fks, doc, 10),
            _fixed(columns, doc, 19, ["", fmt.VIEWS_HEADING, ""]),
            _either(views_present, doc, 20, [], [fmt.NO_VIEWS]),
            views.select(F.inline(view_block)),
            _fixed(columns, doc, 29, ["", fmt.TABLES_HEADING, ""]),
            _either(tables_present, doc, 30, [], [fmt.NO_TABLES]),
            tables.select(F.inline(table_block)),
            columns.select(*_line(doc, 31, table, F.col("ordinal") + 100, row)),
            tables.select(*_line(doc, 31, table, F.lit(_LAST), F.lit(""))),
        ]
    )


def models_markdown(models: DataFrame, columns: DataFrame, project: str) -> DataFrame:
    """LINES of the catalog document of a model project, models in name order.

    ``models``: name, summary, chart; ``columns``: model_name, column_name, ordinal,
    data_type, description (null if none was generated).
    """
    doc, name = project, F.col("name")
    counted = columns.groupBy(F.col("model_name").alias("name")).agg(
        F.count(F.lit(1)).alias("column_count")
    )
    block = _block(
        doc, 1, name,
        ["", F.format_string(fmt.MODEL_HEADING, name), "", fmt.MODEL_SUMMARY_HEADING,
         F.format_string(fmt.QUOTE_FORMAT, F.coalesce(F.col("summary"), F.lit(fmt.NO_SUMMARY))),
         "", fmt.MODEL_LINEAGE_HEADING, F.coalesce(F.col("chart"), F.lit(fmt.NO_CHART)), "",
         fmt.COLUMN_DETAILS_HEADING, fmt.COLUMN_TABLE_HEADER, fmt.COLUMN_TABLE_RULE],
    )
    row = F.format_string(
        fmt.COLUMN_ROW_FORMAT,
        F.col("column_name"),
        F.col("data_type"),
        F.coalesce("description", F.lit(fmt.NO_DESCRIPTION)),
    )
    bare = models.join(counted, "name", "left_anti")
    return union_all(
        [
            _fixed(models, doc, 0, [fmt.MODELS_TITLE % project]),
            models.select(F.inline(block)),
            columns.select(*_line(doc, 1, F.col("model_name"), F.col("ordinal") + 100, row)),
            bare.select(*_line(doc, 1, name, F.lit(100), F.lit(fmt.NO_COLUMNS_ROW))),
        ]
    )


def lineage_markdown(
    spark: SparkSession, graph: DataFrame | None, doc_name: str = "lineage"
) -> DataFrame:
    """LINES of the lineage document around the graph text of `lineage_mermaid`.

    Without a graph the document shows a placeholder.
    """
    opening = [fmt.LINEAGE_TITLE, "", fmt.FENCE + "mermaid"]
    if graph is None:
        lines = [*opening, *fmt.NO_LINEAGE, fmt.FENCE]
        return local_frame(
            spark, [(doc_name, 0, "", i, line) for i, line in enumerate(lines)], "LINES"
        )
    shifted = graph.select(
        F.lit(doc_name).alias("doc_name"), (F.col("section") + 10).alias("section"), *_LINES[2:]
    )
    return union_all(
        [
            _fixed(graph, doc_name, 0, opening),
            shifted,
            _fixed(graph, doc_name, 20, [fmt.FENCE]),
        ]
    )


def comment_statements(
    columns: DataFrame, summaries: DataFrame, views: DataFrame, schema: str
) -> DataFrame:
    """LINES with one COMMENT statement each: views, then every table and its columns."""

    def text(c: str) -> Column:
        return escape_quotes(F.coalesce(F.col(c), F.lit("")))

    view, table = F.col("view_name"), F.col("table_name")
    doc = "comments"
    on_view = F.format_string(fmt.COMMENT_VIEW_FORMAT, F.lit(schema), view, text("summary"))
    on_table = F.format_string(fmt.COMMENT_TABLE_FORMAT, F.lit(schema), table, text("summary"))
    on_column = F.format_string(
        fmt.COMMENT_COLUMN_FORMAT,
        F.lit(schema),
        table,
        F.col("column_name"),
        text("description"),
    )
    summarised = summaries.filter(F.coalesce(F.col("summary"), F.lit("")) != "")
    return union_all(
        [
            views.select(*_line(doc, 0, view, F.lit(0), on_view)),
            summarised.select(*_line(doc, 1, table, F.lit(0), on_table)),
            columns.select(*_line(doc, 1, table, F.col("ordinal"), on_column)),
        ]
    )


def assemble_catalog(
    catalog: DataFrame,
    views: DataFrame,
    fks: DataFrame,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Catalog records: one per table, view and foreign key.

    ``catalog`` has one row per column with its statistics and description (see
    `lakedoc.plans.catalog.build_catalog`) and is read once. ``record`` tells the
    kind; the fields of the other kinds are null. A table's columns are nested in
    source order. Without ``summaries``
    (table_name, summary) the default text is made from the nested names.
    """
    column = F.struct(
        "ordinal",
        F.col("column_name").alias("name"),
        F.col("data_type").alias("type"),
        "description",
        F.struct("null_ratio", "distinct_count", "is_unique").alias("profile_stats"),
    )
    nested = catalog.groupBy("table_name").agg(
        F.array_sort(F.collect_set(column)).alias("columns")
    )
    if summaries is None:
        names = F.array_join(F.col("columns.name"), ", ")
        nested = nested.withColumn("summary", table_summary(F.col("table_name"), names))
    else:
        texts = summaries.select("table_name", "summary")
        nested = nested.join(texts, "table_name", "left")
    nested = nested.withColumn(
        "columns", F.transform("columns", lambda c: c.dropFields("ordinal"))
    )
    text = ["definition", "source_column", "target_table", "target_column"]
    none = {c: F.lit(None).cast("string") for c in text}
    no_columns = F.lit(None).cast(nested.schema["columns"].dataType)
    tables = nested.select(
        F.lit("table").alias("record"),
        F.col("table_name").alias("name"),
        "summary",
        "columns",
        *[none[c].alias(c) for c in text],
    )
    view_records = views.select(
        F.lit("view").alias("record"),
        F.col("view_name").alias("name"),
        "summary",
        no_columns.alias("columns"),
        "definition",
        *[none[c].alias(c) for c in text[1:]],
    )
    fk_records = fks.select(
        F.lit("foreign_key").alias("record"),
        F.col("source_table").alias("name"),
        F.lit(None).cast("string").alias("summary"),
        no_columns.alias("columns"),
        none["definition"].alias("definition"),
        *text[1:],
    )
    return union_all([tables, view_records, fk_records])
