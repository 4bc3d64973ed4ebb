"""Reading back a catalog that was written before."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .files import spark_uri

CATALOG = (
    "record string, name string, part int, summary string,"
    " columns array<struct<name:string,type:string,description:string,"
    "profile_stats:struct<null_ratio:double,distinct_count:bigint,is_unique:boolean>>>,"
    " definition string, source_column string, target_table string, target_column string"
)


def read_catalog(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Catalog records written by `lakedoc.sinks.files.write_json` (or as parquet)."""
    try:
        return spark.read.format(fmt).schema(CATALOG).load(spark_uri(path))
    except AnalysisException as problem:
        raise FileNotFoundError(f"no catalog at {path}; write one first") from problem
