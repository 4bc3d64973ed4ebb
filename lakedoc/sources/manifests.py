"""Project manifests (``target/manifest.json``) as a frame of parsed structs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import spark_uri

_NODE = (
    "struct<resource_type:string,name:string,source_name:string,description:string,"
    "path:string,original_file_path:string,raw_code:string,raw_sql:string,"
    "config:struct<description:string>,depends_on:struct<nodes:array<string>>,"
    "columns:map<string,struct<name:string,description:string,data_type:string>>>"
)
_SOURCE = "struct<resource_type:string,source_name:string,name:string>"
MANIFEST = f"nodes map<string,{_NODE}>, sources map<string,{_SOURCE}>, _malformed string"


def parse_manifests(texts: DataFrame, strict: bool = False) -> DataFrame:
    """``manifest_path, manifest, error`` from ``manifest_path, value`` (JSON text).

    Unknown fields are ignored. Malformed text gives a null struct and an error;
    with ``strict`` the job fails instead, naming the file.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    parsed = texts.select(
        "manifest_path", F.from_json("value", MANIFEST, options).alias("manifest")
    )
    bad = F.col("manifest").isNull() | F.col("manifest._malformed").isNotNull()
    message = F.concat(F.lit("not a valid manifest: "), F.col("manifest_path"))
    error = F.when(bad, F.raise_error(message) if strict else message)
    good = F.when(~bad, F.col("manifest").dropFields("_malformed"))
    return parsed.select("manifest_path", good.alias("manifest"), error.alias("error"))


def scan_manifests(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """Parsed manifests of project folders (or of manifest files, or patterns)."""
    paths = [paths] if isinstance(paths, str) else paths
    files = [p if p.endswith(".json") else p.rstrip("/") + "/target/manifest.json" for p in paths]
    try:
        texts = spark.read.text([spark_uri(file) for file in files], wholetext=True)
    except AnalysisException as problem:
        raise FileNotFoundError(
            f"no manifest at {', '.join(files)}; compile the project first"
        ) from problem
    return parse_manifests(
        texts.select(F.col("_metadata.file_path").alias("manifest_path"), "value"), strict
    )
