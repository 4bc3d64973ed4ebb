"""Canonical schemas of the frames that operators exchange."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_DDL = {
    "DATASETS": "dataset string, path string, format string, bytes long, files long",
    "COLUMNS": "table_name string, column_name string, ordinal int, data_type string,"
    " is_nullable boolean, is_pk boolean, description string",
    "VIEWS": "view_name string, definition string",
    "FKS": "source_table string, source_column string, target_table string,"
    " target_column string",
    "PROFILE": "table_name string, column_name string, total_count long,"
    " null_count long, distinct_count long, null_ratio double, is_unique boolean,"
    " profile_status string",
    "MODELS": "unique_id string, name string, description string, raw_sql string,"
    " path string, original_file_path string",
    "MODEL_COLUMNS": "unique_id string, model_name string, column_name string,"
    " ordinal int, description string, data_type string",
    "MODEL_DEPS": "model_name string, dependency string, dep_kind string",
    "DOCS": "node_type string, model_name string, column_name string, doc_key string,"
    " doc_value string, file_path string",
    "PROPOSALS": "model_name string, column_name string, doc_key string,"
    " proposed_value string, original_file_path string",
    "DECISIONS": "model_name string, column_name string, doc_key string,"
    " decision string, edited_value string",
    "FINDINGS": "model_name string, column_name string, doc_key string, finding string",
    "NODES": "id string, label string, style string",
    "EDGES": "id string, source string, target string, label string",
    # A document is a set of ordered lines, never one large string: the order is
    # (section, part, ordinal), so a sort spreads even a huge document over tasks.
    "LINES": "doc_name string, section int, part string, ordinal long, line string",
    "METADATA": "description string, meta map<string,boolean>, tags array<string>,"
    " tests array<string>",
}


def schema(name: str) -> StructType:
    """The canonical schema ``name`` (see the table above) as a StructType."""
    return StructType.fromDDL(_DDL[name])


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small driver-side list (schema facts, rules) as a local relation.

    Going through Arrow gives the optimizer a LocalRelation of known size, where a
    plain list would become an opaque RDD.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = StructType.fromDDL(_DDL.get(ddl, ddl))
    arrow = to_arrow_schema(struct)
    data = [
        pa.array([row[i] for row in rows], type=field.type)
        for i, field in enumerate(arrow)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(data, schema=arrow), struct)
