"""From tables to a described catalog."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import list_all_columns
from ..operators.profile import profile_database
from ..operators.render import assemble_catalog
from ..operators.rules import describe_columns, describe_views
from ..schemas import local_frame


def build_catalog(tables: dict[str, DataFrame], **profile_options) -> DataFrame:
    """COLUMNS with statistics, role and description: the answer to "what is in here?"."""
    facts = list_all_columns(tables).drop("description")
    described = describe_columns(profile_database(tables, **profile_options))
    # Both sides have one row per column of the given tables.
    return facts.join(F.broadcast(described), ["table_name", "column_name"])


def catalog_records(
    catalog: DataFrame, views: DataFrame, fks: DataFrame
) -> DataFrame:
    """Nested records (see `assemble_catalog`) of a catalog built by `build_catalog`."""
    return assemble_catalog(catalog, describe_views(views), fks)


def profile_to_path(
    tables: dict[str, DataFrame], path: str, tables_per_job: int = 50, **profile_options
) -> list[str]:
    """Profile a lake of any number of tables in bounded plans, appending to ``path``.

    Each batch is one job and becomes durable on its own, so a run that is cut short
    continues with the tables that are not yet there: those without rows for the same
    name, schema and options (the column ``profile_key``). Returns the names profiled now.
    """
    keys = {name: _profile_key(name, df, profile_options) for name, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    done: set[str] = set()
    try:
        saved = spark.read.parquet(path).select("profile_key").distinct()
        done = {row.profile_key for row in saved.toLocalIterator()}
    except AnalysisException:
        pass
    todo = [name for name in tables if keys[name] not in done]
    for start in range(0, len(todo), tables_per_job):
        batch = {name: tables[name] for name in todo[start : start + tables_per_job]}
        named = local_frame(
            spark, [(n, keys[n]) for n in batch], "table_name string, profile_key string"
        )
        # one row per column of the batch, against one per table
        rows = profile_database(batch, **profile_options).join(F.broadcast(named), "table_name")
        rows.write.mode("append").parquet(path)
    return todo


def _profile_key(name: str, df: DataFrame, options: dict) -> str:
    told = json.dumps([name, df.schema.jsonValue(), sorted(options.items())], default=str)
    return hashlib.sha256(told.encode()).hexdigest()
