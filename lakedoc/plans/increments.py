"""Profiles of tables that grow: only parts that are new are read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sketches import merge_sketches, profile_of_sketches, sketch_parts



def stored_sketches(spark: SparkSession, path: str) -> DataFrame | None:
    """SKETCHES in ``path``, of every table and part the latest version; None if there are none."""
    try:
        saved = spark.read.parquet(path)
    except AnalysisException:
        return None
    latest = F.max("version").over(W.partitionBy("table_name", "part"))
    return saved.withColumn("latest", latest).where("version = latest").drop("latest", "version")


def sketch_to_path(
    df: DataFrame, table_name: str, part: str | Column, path: str, *, again: list[str | None] = (), **options
) -> list[str | None]:
    """Add the sketches of parts that ``path`` lacks, and of those in ``again``.

    The filter on ``part`` reaches the scan: where it is a partition column, other
    partitions are not read. The names of the parts (one short text each) pass through the
    driver, the rows do not. Each call is one write that becomes visible as a whole, so a
    call that is cut short is repeated. Returns the parts sketched now.
    """
    spark = df.sparkSession
    column = F.col(part) if isinstance(part, str) else part
    done: set[str | None] = set()
    version = 0
    try:
        own = spark.read.parquet(path).where(F.col("table_name") == table_name)
        done = {row[0] for row in own.select("part").distinct().collect()}
        version = own.agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        pass
    open_parts = df.where(~_among(column, done - set(again)))
    todo = [row[0] for row in open_parts.select(column.cast("string").alias("part")).distinct().collect()]
    if not todo:
        return []
    fresh = sketch_parts(df.where(_among(column, set(todo))), table_name, part, **options)
    fresh.withColumn("version", F.lit(version + 1)).write.mode("append").parquet(path)
    return sorted(todo, key=lambda name: (name is not None, name or ""))


def _among(column: Column, parts: set[str | None]) -> Column:
    """Whether the part is one of these, never null."""
    named = sorted(part for part in parts if part is not None)
    found = F.coalesce(column.cast("string").isin(named), F.lit(False)) if named else F.lit(False)
    return found | column.isNull() if None in parts else found


def profile_from_path(spark: SparkSession, path: str) -> DataFrame | None:
    """Profile of every table in ``path`` from its sketches; see `profile_of_sketches`."""
    sketches = stored_sketches(spark, path)
    return None if sketches is None else profile_of_sketches(merge_sketches(sketches))
