"""File sources: local paths and object stores alike (``s3a://`` and others)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Data source by file ending; anything else is taken for parquet.
_FORMATS = {
    "csv": "csv",
    "tsv": "csv",
    "json": "json",
    "jsonl": "json",
    "ndjson": "json",
    "orc": "orc",
    "avro": "avro",
    "txt": "text",
}
_INFERRED = {"csv", "json"}


def spark_uri(path: str) -> str:
    """The path in the scheme that Spark's object-store connector uses."""
    return "s3a://" + path[len("s3://") :] if path.startswith("s3://") else path


def format_of(path: str) -> str:
    """Spark data source for a file name; parquet if the ending says nothing."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for ending in (".gz", ".bz2", ".zst", ".lz4"):
        name = name.removesuffix(ending)
    suffix = name.rsplit(".", 1)[-1] if "." in name else ""
    return _FORMATS.get(suffix, "parquet")


def scan_files(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    sampling_ratio: float | None = None,
    **options: str,
) -> DataFrame:
    """One file, pattern or directory as one table, with its schema inferred.

    Columnar formats take the schema from their footers. CSV and JSON infer it from
    ``sampling_ratio`` of the rows (all by default; give a schema through
    ``spark.read`` for large text inputs).
    """
    fmt = fmt or format_of(path)
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        delimiter = "\t" if ".tsv" in path.lower() else ","
        reader = reader.option("header", True).option("inferSchema", True)
        reader = reader.option("sep", options.get("sep", delimiter))
    if fmt in _INFERRED and sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)
    return reader.load(spark_uri(path))


def is_listing(path: str) -> bool:
    """Whether a path stands for many datasets rather than one."""
    return path.endswith("/") or "*" in path


def list_datasets(spark: SparkSession, path: str) -> DataFrame:
    """DATASETS below a path: a trailing ``/`` or a ``*`` lists what lies there.

    A file is a dataset, and so is a folder with all files below it (partitions
    included). If the path itself holds ``key=value`` folders it is the one dataset.
    Names that begin with ``_`` or ``.``, and single files without an ending, are left out. Any other path is itself the one
    dataset. Only file status is read: the content column of the binary source is pruned.
    """
    if not is_listing(path):
        return spark.range(1).select(
            F.lit(path).alias("dataset"),
            F.lit(spark_uri(path)).alias("path"),
            F.lit(format_of(path)).alias("format"),
            F.lit(None).cast("long").alias("bytes"),
            F.lit(None).cast("long").alias("files"),
        )
    base, _, pattern = spark_uri(path).rpartition("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(base or "/")
    root = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(f"{base}/{pattern}")
        .select("path", "length")
    )
    plain = lambda text: F.regexp_replace(text, "^([A-Za-z0-9]+):/+", "$1:/")
    below = F.ltrim(F.substr(plain(F.col("path")), F.length(plain(F.lit(root))) + 1), F.lit("/"))
    first = F.substring_index(below, "/", 1)
    whole = first.contains("=")
    name = F.when(whole, F.lit(root.rstrip("/").rsplit("/", 1)[-1])).otherwise(first)
    place = F.when(whole, F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), first))
    bare = F.regexp_replace(F.lower(F.col("path")), r"\.(gz|bz2|zst|lz4)$", "")
    suffix = F.substring_index(bare, ".", -1)
    kind = F.lit("parquet")
    for ending, source in _FORMATS.items():
        kind = F.when(suffix == ending, source).otherwise(kind)
    visible = files.filter(~below.rlike("(^|/)[_.]") & below.rlike("[/.]"))
    return (
        visible.select(name.alias("dataset"), place.alias("path"), kind.alias("format"), "length")
        .groupBy("dataset", "path")
        .agg(
            F.max("format").alias("format"),
            F.sum("length").alias("bytes"),
            F.count(F.lit(1)).alias("files"),
        )
    )
