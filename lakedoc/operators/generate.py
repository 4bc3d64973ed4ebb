"""Text generation over prompt rows, and parsing of generated metadata."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim_all
from ..schemas import schema
from ..sinks.durable import durable

ROWS_AT_ONCE = 64  # prompts that Python holds as objects, whatever the size of a batch


def generate(
    prompts: DataFrame,
    fn: Callable[[str, int], str],
    *,
    partitions: int | None = None,
    keep: bool = False,
) -> DataFrame:
    """Call ``fn(prompt, max_tokens)`` for every row; adds ``answer`` and ``error``.

    ``prompts`` needs the columns ``prompt`` and ``max_tokens``. An exception becomes
    the text of ``error`` and leaves ``answer`` null. ``partitions`` sets how many
    calls run side by side. ``keep`` stores the answers durably before they are used,
    so that a lost executor or a second use does not repeat paid calls.
    """
    if partitions:
        prompts = prompts.repartition(partitions)
    answered = T.StructType(list(prompts.schema.fields))
    answered = answered.add("answer", "string").add("error", "string")

    at, names = [prompts.columns.index(c) for c in ("prompt", "max_tokens")], answered.names

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                answers, errors = [], []
                for prompt, budget in zip(*(batch.column(i).to_pylist() for i in at)):
                    try:
                        answers.append(fn(prompt, int(budget)))
                        errors.append(None)
                    except Exception as problem:
                        answers.append(None)
                        errors.append(f"{type(problem).__name__}: {problem}")
                added = [pa.array(texts, pa.string()) for texts in (answers, errors)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    result = prompts.mapInArrow(ask, answered).withColumn("answer", trim_all(F.col("answer")))
    return durable(result) if keep else result


def _metadata_parser() -> Callable[[str | None], dict]:
    """Parser of one generated snippet.

    It is built from nested functions, which travel to the executors by value: they
    need PyYAML there, but not this package.
    """
    import yaml

    def as_text(value) -> str:
        if isinstance(value, str):
            return value
        return json.dumps(value, ensure_ascii=False, default=str)

    def texts(values) -> list[str] | None:
        return [as_text(v) for v in values] if isinstance(values, list) else None

    def metadata(text: str | None) -> dict:
        row = {"description": None, "meta": None, "tags": None, "tests": None}
        if text is None:
            return row
        try:
            loaded = yaml.safe_load(text)
        except yaml.YAMLError:
            loaded = None
        if not isinstance(loaded, dict):  # the generator wrote plain text
            return {**row, "description": text.strip()}
        described, meta = loaded.get("description"), loaded.get("meta")
        if described is not None:
            row["description"] = as_text(described)
        if isinstance(meta, dict):
            row["meta"] = {str(k): bool(v) for k, v in meta.items()}
        return {**row, "tags": texts(loaded.get("tags")), "tests": texts(loaded.get("tests"))}

    return metadata


def parse_yaml_metadata(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Adds the METADATA struct ``metadata`` parsed from generated YAML.

    Parsing is slow and the texts are short, so they are dealt out anew: by their bytes they
    would be read by few tasks.
    """
    answers = answers.repartition(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = T.StructType(list(answers.schema.fields)).add("metadata", schema("METADATA"))
    metadata = _metadata_parser()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(metadata=[metadata(t) for t in batch[text]])

    return answers.mapInPandas(parse, parsed)


def json_metadata(text: Column) -> Column:
    """METADATA struct from generated JSON; plain text if it is no object."""
    parsed = F.from_json(text, schema("METADATA"))
    filled = F.coalesce(
        parsed["description"].isNotNull()
        | parsed["meta"].isNotNull()
        | parsed["tags"].isNotNull()
        | parsed["tests"].isNotNull(),
        F.lit(False),
    )
    is_object = trim_all(text).startswith("{") & trim_all(text).endswith("}")
    fallback = F.struct(
        trim_all(text).alias("description"),
        *[
            F.lit(None).cast(schema("METADATA")[k].dataType).alias(k)
            for k in ("meta", "tags", "tests")
        ],
    )
    return F.when(filled | (is_object & parsed.isNotNull()), parsed).otherwise(fallback)
