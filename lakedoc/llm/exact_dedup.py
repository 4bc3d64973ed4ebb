"""Operator 8: exact deduplication with Patricia tries as owners of texts.

Method: rows meet in partitions by length and hash of the normalised text (A-Z in lower
case). There a compressed radix trie takes the full byte strings; its terminal nodes hold
the owner of the text and subtrees go to disk beyond a memory limit. Equality is decided
byte by byte in the trie; the hash only deals out and carries the answer back.

Skew: every map task first passes its rows through such a trie, so a text that fills a
third of the table reaches the second stage once per task. The answer goes back to the
rows with an equi-join whose small side has one row per text, which adaptive execution
splits where a text is frequent.

Defined results: null and empty texts are equal; null ids rank below all others; of rows
that repeat the winning id, one stays; an empty table gives no rows; further columns are
ignored by `exact_groups` and kept by `exact_dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, lowered, texts
from .trie import OwnerTrie

_NO_ID = -(1 << 63)  # stands for a null id, below all others


def _merge(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """Of owners ``(id, rows with that id, rows)``; the largest id wins."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1], a[2] + b[2]
    return (a if a[0] > b[0] else b)[:2] + (a[2] + b[2],)


def _owners(limit: int, flush_rows: int | None):
    """Worker function: rows of equal text become one; texts leave a trie as they came."""

    def emit(trie: OwnerTrie) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for key, owner in trie.items():
            part.append((key, *owner))
            size += len(key)
            if size > 8 << 20 or len(part) >= 4096:
                yield _batch(part)
                part, size = [], 0
        if part:
            yield _batch(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = OwnerTrie(_merge, limit), 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for key, *owner in zip(*(c.to_pylist() for c in columns)):
                trie.insert(key, tuple(owner))
                held += len(key)
            if flush_rows is not None and held > flush_rows:  # map side: no spill, just pass on
                yield from emit(trie)
                trie, held = OwnerTrie(_merge, limit), 0
        yield from emit(trie)

    return run


_OWNED = "body binary, keep_id long, n_keep long, group_size long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    body, keep, n_keep, size = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(body, pa.binary()),
            pa.array(keep, pa.int64()),
            pa.array(n_keep, pa.int64()),
            pa.array(size, pa.int64()),
        ],
        names=["body", "keep_id", "n_keep", "group_size"],
    )


def _once(repeated, sha):
    """Key that rows repeating the winning id share; any other row is alone under its own."""
    own = F.monotonically_increasing_id().cast("string")
    return F.when(repeated, F.concat(F.lit("="), sha)).otherwise(own)


def owners(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 128 << 20
) -> DataFrame:
    """One row per distinct normalised text: ``text_sha256, keep_id, n_keep, group_size``.

    ``n_keep`` counts the rows that carry the id ``keep_id``; ``limit`` bounds the bytes
    of text that one task's trie holds in memory.
    """
    rows = texts(docs, id_col, text_col).select(
        lowered(F.col("text")).cast("binary").alias("body"),
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("keep_id"),
        F.lit(1).cast("long").alias("n_keep"),
        F.lit(1).cast("long").alias("group_size"),
    )
    combined = rows.mapInArrow(_owners(limit, limit // 2), _OWNED)
    dealt = combined.repartition(F.length("body"), F.xxhash64("body"))
    owned = dealt.mapInArrow(_owners(limit, None), _OWNED)
    return owned.select(
        F.sha2("body", 256).alias("text_sha256"),
        F.when(F.col("keep_id") != _NO_ID, F.col("keep_id")).alias("keep_id"),
        "n_keep",
        "group_size",
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Every row: ``doc_id, keep_id, group_size, kept, text_sha256``; one per text is kept."""
    rows = texts(docs, id_col, text_col).select(
        "doc_id", F.sha2(lowered(F.col("text")), 256).alias("text_sha256")
    )
    joined = rows.join(
        owners(docs, id_col, text_col, **options).hint("merge"), "text_sha256"
    )
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    numbered_by = _once(winner & (F.col("n_keep") > 1), F.col("text_sha256"))
    numbered = joined.withColumn("alone", numbered_by).withColumn(
        "nth", F.row_number().over(W.partitionBy("alone").orderBy("doc_id"))
    )
    return numbered.select(
        "doc_id",
        "keep_id",
        "group_size",
        (winner & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that `exact_groups` keeps."""
    sha, keep, n, once = fresh(docs, "sha", "keep", "n", "once")
    best = owners(docs, id_col, text_col).select(
        F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.col("n_keep").alias(n)
    )
    body = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    joined = docs.withColumn(sha, F.sha2(lowered(body), 256)).join(best.hint("merge"), sha)
    kept = joined.filter(F.col(id_col).cast("long").eqNullSafe(F.col(keep)))
    unique = kept.withColumn(once, _once(F.col(n) > 1, F.col(sha))).dropDuplicates([once])
    return unique.select(*docs.columns)


ORACLE_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
best AS (SELECT body, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size
         FROM normal GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM normal JOIN best USING (body)
"""


def sha256_hex(text: str | None) -> str:
    """The digest of `exact_groups` for one text, for tests."""
    body = (text or "").encode().lower()
    return hashlib.sha256(body).hexdigest()
