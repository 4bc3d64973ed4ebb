"""Documentation files (YAML) as DOCS rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import schema
from .files import spark_uri

# The folders searched and the sections that list documented nodes.
FOLDERS = ("models", "seeds", "snapshots")
NODE_TYPES = ("models", "sources", "seeds", "snapshots")


def parse_docs(files: DataFrame, strict: bool = True) -> DataFrame:
    """DOCS rows from ``file_path, value`` (whole YAML texts).

    Values that are not strings are kept as JSON, empty ones as null. Malformed YAML
    fails the job and names the file, or unless ``strict`` gives one row with the key
    ``parse_error`` and neither type nor model. The parser is made of nested functions, which travel to the
    executors by value: they need PyYAML there, but not this package.
    """
    import yaml

    columns, node_types = schema("DOCS").names, NODE_TYPES

    def doc_value(value) -> str | None:
        if value is None or value is False or value == [] or value == {}:
            return None  # empty in its own type: counts as missing
        if isinstance(value, str):
            return value
        return json.dumps(value, ensure_ascii=False, default=str)

    def text_of(name) -> str:
        """YAML reads bare names like ``2024`` or ``no`` as other types."""
        return name if isinstance(name, str) else json.dumps(name, default=str)

    def entries(node_type: str, model: str, column: str | None, fields: dict, path: str):
        yield node_type, model, column, "name", column or model, path
        for key, value in fields.items():
            if key not in ("name", "columns"):
                yield node_type, model, column, str(key), doc_value(value), path

    def named(items) -> list[dict]:
        listed = items if isinstance(items, list) else []
        return [
            {**i, "name": text_of(i["name"])}
            for i in listed
            if isinstance(i, dict) and i.get("name") not in (None, "")
        ]

    def doc_rows(text: str, path: str) -> Iterator[tuple]:
        try:
            content = yaml.safe_load(text)
        except yaml.YAMLError as problem:
            if strict:
                raise ValueError(f"failed to parse {path}: {problem}") from problem
            yield None, None, None, "parse_error", str(problem), path
            return
        if not isinstance(content, dict):
            return
        for node_type in node_types:
            for node in named(content.get(node_type)):
                yield from entries(node_type, node["name"], None, node, path)
                for column in named(node.get("columns")):
                    yield from entries(node_type, node["name"], column["name"], column, path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                row
                for text, path in zip(batch["value"], batch["file_path"])
                for row in doc_rows(text, path)
            ]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return files.select("file_path", "value").mapInPandas(parse, schema("DOCS"))


def scan_docs(
    spark: SparkSession, project_dirs: str | list[str], strict: bool = True
) -> DataFrame:
    """DOCS of all documentation files below the model, seed and snapshot folders."""
    dirs = [project_dirs] if isinstance(project_dirs, str) else project_dirs
    roots = [f"{spark_uri(d).rstrip('/')}/{{{','.join(FOLDERS)}}}" for d in dirs]
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{yml,yaml}")
        .text(roots, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file_path"), "value")
    )
    name = F.substring_index("file_path", "/", -1)
    return parse_docs(texts.filter(~name.contains("dbt_project")), strict)
