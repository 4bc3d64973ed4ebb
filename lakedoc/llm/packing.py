"""Operator 4: best-fit packing of documents into sequences.

Method: large-item matching. Pieces of more than a third of the capacity meet at most
twice in a sequence: going down the sizes, each takes the largest other large piece that
still fits. The smaller pieces then go, largest first, into the sequence with the least
room that takes them (best fit), and into new sequences when none does.

Only the *lengths* decide, and there are at most ``capacity`` of them. So the plan is made
from the number of pieces of each length, for whole classes of sequences filled alike:
its cost depends on the capacity, not on the corpus. A plan row says which sequence
numbers and which offset the pieces of one length with the ranks ``low <= rank < high``
get. Pieces get their rank within their length from counts per partition; no length is
ever gathered in one task, however common it is.

Defined results: null and empty texts are one piece, the end id alone; null and repeated
ids are documents of their own; an empty table gives no rows; further columns are
ignored. Texts are taken whole; only documents longer than the capacity are cut.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hf
from .common import slices, stored, texts

CAPACITY = 2048
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids; ``with_ids`` adds the ids as bytes."""
    tail, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = hf.encoder(tokenizer)
        for batch in slices(batches, 256):
            rows, bodies = [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode(text) + tail
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    bodies.append(part)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(bodies, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = _PIECE + (", ids binary" if with_ids else "")
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


class _Class:
    """``count`` sequences that hold the same lengths; ``room`` is left in each."""

    __slots__ = ("lengths", "count", "room")

    def __init__(self, lengths: tuple[int, ...], count: int, room: int):
        self.lengths, self.count, self.room = lengths, count, room


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, number of sequences filled so)`` for the given number of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not (0 < min(left) and max(left) <= capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    rooms: list[int] = []  # sorted rooms that some class has
    by_room: dict[int, list[_Class]] = {}
    full: list[_Class] = []

    def add(lengths: tuple[int, ...], count: int, room: int) -> None:
        if count and room == 0:
            full.append(_Class(lengths, count, 0))
        elif count:
            if room not in by_room:
                bisect.insort(rooms, room)
                by_room[room] = []
            by_room[room].append(_Class(lengths, count, room))

    def take(room: int) -> _Class:
        found = by_room[room].pop()
        if not by_room[room]:
            del by_room[room]
            rooms.remove(room)
        return found

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        first = large[-1]
        at = bisect.bisect_right(large, capacity - first) - 1
        if at < 0:  # nothing large fits with it
            add((first,), left.pop(first), capacity - first)
            large.pop()
            continue
        second = large[at]
        if second == first:
            pairs = left[first] // 2
            add((first, first), pairs, capacity - 2 * first)
            left[first] -= 2 * pairs
            if left[first]:  # one is left over; it looks for a smaller one
                rest = [n for n in large if n < first]
                left[first] = 0
                if rest:
                    add((first, rest[-1]), 1, capacity - first - rest[-1])
                    left[rest[-1]] -= 1
                else:
                    add((first,), 1, capacity - first)
        else:
            pairs = min(left[first], left[second])
            add((first, second), pairs, capacity - first - second)
            left[first] -= pairs
            left[second] -= pairs
        for n in (first, second):
            if n in left and left[n] == 0:
                del left[n]
        large = [n for n in large if n in left and left[n]]

    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left.pop(size)
        while count:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):  # none has room: new sequences
                each = capacity // size
                add((size,) * each, count // each, capacity - each * size)
                rest = count % each
                add((size,) * rest, 1 if rest else 0, capacity - rest * size)
                break
            group = take(rooms[at])
            each = group.room // size
            whole = min(group.count, count // each)
            if whole:
                add(group.lengths + (size,) * each, whole, group.room - each * size)
                count -= whole * each
            if whole < group.count:  # then less than one filling is left
                if count:
                    add(group.lengths + (size,) * count, 1, group.room - count * size)
                    whole, count = whole + 1, 0
                add(group.lengths, group.count - whole, group.room)
    return [
        (group.lengths, group.count)
        for group in [*full, *(g for groups in by_room.values() for g in groups)]
    ]


def plan_rows(filled: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, low, high, sequence, offset)``: where the ranks of each length go.

    A rank in ``[low, high)`` goes to the sequence ``sequence + rank - low``.
    """
    rows, used, sequence = [], {}, 0
    for lengths, count in filled:
        offset = 0
        for n in lengths:
            low = used.get(n, 0)
            rows.append((n, low, low + count, sequence, offset))
            used[n] = low + count
            offset += n
        sequence += count
    return rows


def _ranked(cut: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) within ``length``: a number inside a bucket of rows plus the
    counts of the buckets before. Buckets split every length evenly by content."""
    buckets = 4 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    rows = cut.withColumn("bucket", dealt)
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    inside = rows.withColumn("inside", F.row_number().over(order) - 1)
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return inside.join(bases, ["length", "bucket"]).select(
        *cut.columns, (F.col("base") + F.col("inside")).alias("rank")
    )


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the pieces ``cut`` (with a column ``length``).

    Gathers one number per length (at most ``capacity``) on the driver and ships the plan.
    """
    counted = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = plan_rows(plan({r["length"]: r["n"] for r in counted}, capacity))
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    shipped = cut.sparkSession.sparkContext.broadcast(table)
    names = [*cut.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, low, _, sequence, offset = shipped.value.T
        width = int(low.max()) + 1 if len(low) else 1
        keys = _keys(length, low, width)
        for batch in batches:
            *columns, rank = batch.columns
            size = batch.column(names.index("length")).to_numpy()
            ranks = rank.to_numpy()
            # the last plan row of the length that begins at or before the rank
            at = np.searchsorted(keys, _keys(size, np.minimum(ranks, width - 1), width), "right")
            at -= 1
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence[at] + ranks - low[at]), pa.array(offset[at])],
                names=names,
            )

    added = [T.StructField(name, T.LongType()) for name in ("sequence_id", "offset")]
    schema = T.StructType([*cut.schema.fields, *added])
    return _ranked(cut).mapInArrow(run, schema)


def _keys(length: np.ndarray, rank: np.ndarray, width: int) -> np.ndarray:
    """Order by length, then rank, in one number; exact up to 2**52 pieces of one length."""
    return length.astype(object) * width + rank if width > 1 << 51 else length * width + rank


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """All pieces of ``docs`` with their place: `pieces` and `assign`."""
    cut = stored(pieces(docs, tokenizer, capacity=capacity, **options), "packing-pieces")
    return assign(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: packed pieces ``with_ids`` as sequences (bytes, in order).

    A group is one sequence, so at most ``capacity`` ids.
    """
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(
        ordered, F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"])
    )
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
