"""What the operators share: input columns, stored intermediate results, Arrow helpers.

All operators read two columns and ignore the rest, so further columns (also with names
that an operator returns) never clash. A null text counts as an empty one. Rows are
documents: a row whose id is null or repeated is a document of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below the configured checkpoint folder.

    Only a local session without that setting gets a temporary one.
    """
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lakedoc-llm-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage: a lost executor costs a read, not the steps before.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``doc_id, text`` of a table of documents; a null text becomes empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``docs`` has them."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def lowered(text):
    """Column ``text`` with A-Z in lower case, and no other character changed."""
    return F.translate(text, UPPER, UPPER.lower())


def slices(
    batches: Iterable[pa.RecordBatch], rows: int = 512
) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of some rows, which bounds what Python holds of them."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state(key, make):
    """What ``make()`` returned at the first call for ``key`` in this Python worker process.

    Functions that travel by value bring their own globals with every task; this keeps
    vocabularies and caches over the tasks that one worker runs.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_lakedoc_llm_worker_state", types.ModuleType("state"))
    if key not in kept.__dict__:
        kept.__dict__[key] = make()
    return kept.__dict__[key]
