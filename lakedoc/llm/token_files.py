"""Operator 3: token ids in Parquet files with selective reads.

Method: a document is one row with a list column of its ids. The ids are dictionary
encoded (a vocabulary of 50 thousand needs 16 bits a token, repeated ones fewer), the
increasing columns ``doc_id`` and ``start`` are delta encoded (format version 2 without a
dictionary). Row groups and pages have set sizes, and the writer adds column and page
indexes, so that a range of documents or the metadata alone is read without the rest.
A small table of files next to them says where in the token stream each file begins.

Plan: texts are dealt out by ranges of ``doc_id`` and sorted, then encoded and written by
the task that holds them, so tokens never move. The start of a document is the sum of all
files before plus a running sum inside its file; only one row a file is summed up globally.

Defined results: null and empty texts have the end id alone; rows with a null id come
first, in any order among themselves, like rows that share an id; an empty table gives no
rows; further columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import hf
from .common import shared_folder, slices, texts

_NO_ID = -(1 << 63)

#: Writer settings: bytes of a row group and of a page, encodings by column.
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#file_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}
_ROW = "part int, doc_id long, file_start long, n_tokens long, tokens array<int>"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = hf.encoder(path)
        start, tail = 0, np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 256):
            parts = [encode(text) + tail for text in batch.column(2).to_pylist()]
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(starts),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), ids),
                ],
                names=["part", "doc_id", "file_start", "n_tokens", "tokens"],
            )

    return run


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    end_id: int = 0,
    partitions: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write ``folder/tokens`` (one file per range of ids) and ``folder/files``."""
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    dealt = (
        rows.withColumn("salt", F.xxhash64("text"))  # splits an id that many rows share
        .repartitionByRange(count, "doc_id", "salt")
        .sortWithinPartitions("doc_id", "salt")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
    )
    encoded = dealt.mapInArrow(_encode(tokenizer, end_id), _ROW)
    encoded.write.options(**LAYOUT).parquet(f"{folder}/tokens")
    written = spark.read.schema(_ROW).parquet(f"{folder}/tokens")
    sums = written.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    files = sums.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"), "n"
    )
    files.write.parquet(f"{folder}/files")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, tokens`` of `write_tokens`; unused columns are not read."""
    rows = spark.read.schema(_ROW).parquet(f"{folder}/tokens")
    files = spark.read.schema("part int, part_start long, n long").parquet(f"{folder}/files")
    return rows.join(F.broadcast(files.drop("n")), "part").select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"),
        (F.col("part_start") + F.col("file_start")).alias("start"),
        "n_tokens",
        "tokens",
    )


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the rows of `read_tokens`."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(
        _check, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_file_digests(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs``, read them back, and digest every document."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    write_tokens(docs, folder, tokenizer)
    return digests(read_tokens(spark, folder))
