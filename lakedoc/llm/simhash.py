"""Operator 6: near-duplicates by SimHash and meet-in-the-middle ball hashing.

Method: two fingerprints that differ in at most ``radius`` bits have a common neighbour
half way. With the radius 3, the 64 bits are dealt into three blocks. Of a linked pair, at
least one block takes one of up to three differing bits; with that block left out the rest
differs in two bits at most, so the balls of radius 1 around both rests meet. Every
distinct fingerprint therefore emits, for each block left out, its rest and all variants
of it with one bit changed (131 keys in all), the keys are shuffled, and fingerprints that
share a key are compared in full. Nothing is missed, and a chance meeting needs two
fingerprints within 2 of 42 bits, so candidates stay few even with billions of them.

Skew: rows with one fingerprint collapse before anything else, so copies cost nothing. A
key is shared by different fingerprints only. A task streams over its sorted keys; of a
key with many fingerprints it returns a spanning forest of the links, not all pairs, and
compares them block by block (memory for one key: 8 bytes a fingerprint).

Links between fingerprints, then components, are found by joins; documents get the
smallest id of their component.

Defined results: null and empty texts have the fingerprint zero and are linked like any
other; texts with fewer than ``words`` words are one shingle; null ids count as larger
than all others when the smallest id is chosen; repeated ids are rows of their own;
an empty table gives no rows; further columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakedoc.operators.joins import lookup_join

from .common import fresh, slices, stored, texts
from .components import components

SEED = 42
BLOCKS = ((0, 22), (22, 43), (43, 64))  # bits from, to


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of the whole text as a signed 64-bit integer."""
    import xxhash

    body = text.encode().lower().split()  # only A-Z change; splits at the six ASCII spaces
    if not body:
        return 0
    joined = b" ".join(body)
    sizes = np.fromiter(map(len, body), np.int64, len(body))
    starts = np.cumsum(sizes + 1) - sizes - 1
    if len(body) > words:
        stops = (starts + sizes)[words - 1 :].tolist()
        starts = starts[: len(stops)].tolist()
    else:
        starts, stops = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(stops), 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = 2 * counts > len(stops)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(text, words) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"]
            )

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _masks() -> list[tuple[int, list[int]]]:
    """For every block: the bits that stay, and each of them."""
    found = []
    for low, high in BLOCKS:
        bits = [1 << i for i in range(64) if not low <= i < high]
        found.append((sum(bits), bits))
    return found


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the balls; ``part`` says which block was left out."""
    for batch in slices(batches, 4096):
        prints = batch.column(0).to_numpy().view("<u8")
        for part, (stay, bits) in enumerate(_masks()):
            rest = prints & np.uint64(stay)
            flips = np.array([0, *bits], "<u8")
            keys = (rest[:, None] ^ flips[None, :]).ravel().view("<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), part, np.int8)),
                    pa.array(keys),
                    pa.array(np.repeat(prints.view("<i8"), len(flips))),
                ],
                names=["part", "key", "fp"],
            )


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (distance up to ``radius``) that connect what all links connect, at most n - 1."""
    n = len(prints)
    values = prints.view("<u8")
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius)
        for j in (near + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                links.append((int(prints[i]), int(prints[j])))
    return links


def _meet(radius: int):
    """Links within runs of equal ``(part, key)``; a run may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            part, key, prints = (np.concatenate(x) for x in zip(held, columns))
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
            last = int(new[-1]) if len(new) else 0
            yield from links_of(prints[:last], np.concatenate([[0], new]) if last else new)
            held = (part[last:], key[last:], prints[last:])
        if len(held[0]):
            yield from links_of(held[2], np.array([0, len(held[0])]))

    def links_of(prints: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(edges)
        first = edges[:-1][sizes == 2]  # the usual case at once
        a, b = prints[first], prints[first + 1]
        near = np.bitwise_count((a ^ b).view("<u8")) <= radius
        pairs = [np.stack([a[near], b[near]], 1)]
        for at, n in zip(edges[:-1][sizes > 2], sizes[sizes > 2]):
            found = forest(prints[at : at + n], radius)
            pairs.append(np.array(found, np.int64).reshape(-1, 2))
        both = np.unique(np.concatenate(pairs), axis=0)
        if len(both):
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"]
            )

    return run


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp``: enough to connect what is linked."""
    if radius != 3:
        raise ValueError("the three blocks are made for the radius 3")
    keys = distinct.select("fp").mapInArrow(_variants, "part tinyint, key long, fp long")
    dealt = keys.repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    return dealt.mapInArrow(_meet(radius), "a long, b long").distinct()


def near_groups(
    docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row: ``doc_id, fingerprint, component_id``."""
    marked = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fps")
    roots = components(links(distinct))
    grouped = distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = lookup_join(grouped, smallest, ["root"]).select("fp", "component_id")
    # a frequent fingerprint is split by adaptive execution: ``named`` has one row for it
    return marked.join(named.hint("merge"), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest id of their component.

    Of rows that repeat an id one stays.
    """
    groups = near_groups(docs, id_col=id_col, text_col=text_col)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = stored(stay.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "near-kept")
    own, named, n, nth = fresh(docs, "own", "named", "times", "nth")
    marked = docs.withColumn(own, F.col(id_col).cast("long"))
    names = ids.select(F.col("doc_id").alias(named), F.col("n").alias(n))
    kept = marked.join(names.hint("merge"), F.col(own).eqNullSafe(F.col(named)))
    if ids.where("n > 1").limit(1).count():
        order = W.partitionBy(own).orderBy(F.xxhash64(text_col))
        once = kept.where(F.col(n) > 1).withColumn(nth, F.row_number().over(order))
        once = once.where(F.col(nth) == 1).drop(nth)
        kept = kept.where(F.col(n) == 1).unionByName(once)
    return kept.select(*docs.columns)
