"""Operator 2: removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes.

Method: texts are cut so that equal strings are sure to meet, and where they meet, a
two-stage suffix sort (`two_stage`) and the common prefixes of neighbours decide.

* Every string of ``length`` bytes has an anchor: its 32-byte piece with the smallest hash
  (the leftmost of equals). Strings that start one after the other mostly share it; such a
  stretch, 200 to 368 bytes long, is a *body*. Equal strings have equal anchors, so
  all repeats of a string lie in bodies of one anchor.
* Anchors that occur in one place only are dropped: first by counting them, with only the
  smallest and the largest place of each kept, so that this aggregates before the shuffle.
* Bodies of the other anchors are summed up to distinct ones. If an anchor has one distinct
  body, its strings repeat exactly if the body does. If it has several, they are suffix
  sorted together, many anchors in one buffer.
* Anchors with very many different bodies (the edges of a passage that a large share of
  all documents quote) are split further: their strings are counted one by one, by two
  64-bit hashes, which spreads any anchor over all tasks.

Equal texts are one text with a number of copies; if it has several, all of it is repeated.
No text, anchor or string is dropped or capped, and no step collects an anchor's
occurrences in one place. Documents are known by 128 bits of the SHA-256 of their text.

Defined results: null and empty texts, and texts shorter than ``length``, have nothing
removed unless their bytes are covered, so nothing; null and repeated ids are rows of
their own (repeated rows are copies); an empty table gives no rows; further columns are
ignored. Texts are taken whole; very long ones are cut into overlapping stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedoc.operators.joins import lookup_join

from . import two_stage
from .common import fresh, slices, stored, texts

LENGTH = 200
ANCHOR = 32
MANY = 4096  # distinct bodies of one anchor that are still sorted together (up to 1.5 MB)
BUFFER = 1 << 20  # bytes of bodies in one suffix sort
STRETCH = 1 << 21  # bytes of a text that are looked at together

_M64 = (1 << 64) - 1


def _mix(n: int) -> int:
    """Bits of a counter, well spread."""
    n = (n * 0x9E3779B97F4A7C15) & _M64
    n = ((n ^ (n >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    n = ((n ^ (n >> 27)) * 0x94D049BB133111EB) & _M64
    return n ^ (n >> 31)


_TABLE = np.array([_mix(i + 1) for i in range(256)], np.uint64)
_TABLE_2 = np.array([_mix(i + 1000) for i in range(256)], np.uint64)


def _rolled(raw: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    """Hash of every ``width`` bytes, joined from hashes of halves."""
    hashes, have = table[raw], 1
    result, done = None, 0
    while True:
        if width & have:
            if result is None:
                result, done = hashes, have
            else:
                n = len(raw) - done - have + 1
                factor = np.uint64(_mix(done + 77) | 1)
                result = hashes[:n] * factor + result[have : have + n]
                done += have
        if done == width:
            break
        factor = np.uint64(_mix(have) | 1)
        hashes = hashes[:-have] * factor + hashes[have:]
        have *= 2
    result = (result ^ (result >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return result ^ (result >> np.uint64(32))


def stretches(body: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, start, count``: of strings that start one after the other and share it."""
    parts = [_stretches(body, at, length) for at in range(0, len(body) - length + 1, STRETCH)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(columns) for columns in zip(*parts))


def _stretches(body: bytes, at: int, length: int):
    raw = np.frombuffer(body, np.uint8, min(len(body) - at, STRETCH + length - 1), at)
    width = min(ANCHOR, length)
    hashes = _rolled(raw, width, _TABLE)
    window = length - width + 1
    starts = len(raw) - length + 1
    # the leftmost smallest hash: high bits of the hash, then the place
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while 2 * have <= window:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:starts], least[window - have : window - have + starts])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    count = np.diff(np.append(first, starts))
    return hashes[place[first]].view(np.int64), first + at, count


def _keys(body: bytes) -> tuple[int, int]:
    """The document's key, as `_with_keys` computes it."""
    two = np.frombuffer(hashlib.sha256(body).digest()[:16], ">i8")
    return int(two[0]), int(two[1])


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, sha, n_bytes, k1, k2``."""
    rows = texts(docs, id_col, text_col).withColumn("sha", F.sha2("text", 256))

    def part(at: int):  # 16 hexadecimal digits as a signed number
        high, low = (
            F.conv(F.substring("sha", at + i, 8), 16, 10).cast("long") for i in (0, 8)
        )
        return F.shiftleft(high, 32).bitwiseOR(low)

    return rows.select(
        "doc_id",
        "text",
        "sha",
        F.octet_length("text").cast("long").alias("n_bytes"),
        part(1).alias("k1"),
        part(17).alias("k2"),
    )


def _count_anchors(length: int):
    """Per batch: each anchor with the smallest and largest place it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found, places = [], []
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy()):
                anchor, start, _ = stretches(text.encode(), length)
                found.append(anchor)
                place = (start.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                places.append((place ^ np.int64(key).view(np.uint64)).view(np.int64))
            anchor, place = np.concatenate(found), np.concatenate(places)
            order = np.lexsort((place, anchor))
            anchor, place = anchor[order], place[order]
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)])
            last = np.append(first[1:], len(anchor)) - 1 if len(first) else first
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[first]), pa.array(place[first]), pa.array(place[last])],
                names=["anchor", "low", "high"],
            )

    return run


def _list_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            found = [np.unique(stretches(t.encode(), length)[0]) for t in batch.column(0).to_pylist()]
            sizes = [len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(found)),
                    pa.array(np.repeat(batch.column(1).to_numpy(), sizes)),
                    pa.array(np.repeat(batch.column(2).to_numpy(), sizes)),
                ],
                names=["anchor", "k1", "k2"],
            )

    return run


def _bodies(text: str, anchors: np.ndarray, length: int):
    """``anchor, start, count, body, hash`` of the stretches with one of the anchors."""
    import xxhash

    raw = text.encode()
    found = zip(*(c.tolist() for c in _among(*stretches(raw, length), anchors)))
    for anchor, start, count in found:
        body = raw[start : start + count + length - 1]
        yield anchor, start, count, body, xxhash.xxh64_intdigest(body) - (1 << 63)


def _among(anchor, start, count, some):
    keep = np.isin(anchor, some)
    return anchor[keep], start[keep], count[keep]


def _extract(length: int):
    """Distinct bodies of each text with their number of copies (2 stands for more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = []
            for k1, k2, text, copies, anchors in zip(*(c.to_pylist() for c in batch.columns)):
                own: dict[tuple[int, int], list] = {}
                for anchor, _, _, body, name in _bodies(text, np.array(anchors), length):
                    if (anchor, name) in own:
                        own[anchor, name][3] = 2
                    else:
                        own[anchor, name] = [anchor, name, body, min(copies, 2), k1, k2]
                rows.extend(own.values())
            if rows:
                kinds = ("int64", "int64", "binary", "int64", "int64", "int64")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, getattr(pa, k)()) for c, k in zip(zip(*rows), kinds)],
                    names=["anchor", "name", "body", "times", "k1", "k2"],
                )

    return run


def _ranges(marks: np.ndarray) -> list[int]:
    """Begins and ends of the runs of true values, in turn."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return edges.tolist()


_REPEATED = "anchor long, name long, ranges array<int>"


def _repeated_batch(rows: list[tuple]) -> pa.RecordBatch:
    anchor, name, ranges = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchor, pa.int64()),
            pa.array(name, pa.int64()),
            pa.array(ranges, pa.list_(pa.int32())),
        ],
        names=["anchor", "name", "ranges"],
    )


def _sort_suffixes(length: int):
    """Rows ``anchor, name, body, times`` sorted by anchor to ``anchor, name, ranges``."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        if rows:
            counts = np.array([len(body) - length + 1 for _, _, body, _ in rows])
            marks = two_stage.repeated_starts([body for _, _, body, _ in rows], counts, length)
            for (anchor, name, _, times), n, mark in zip(rows, counts.tolist(), marks):
                ranges = [0, n] if times > 1 else _ranges(mark)
                if ranges:
                    out.append((anchor, name, ranges))
        if out:
            yield _repeated_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size, group, done = [], 0, [], []
        for batch in slices(batches, 4096):
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    if len(group) > 1:
                        ready += group
                        size += sum(len(body) for _, _, body, _ in group)
                    elif group[0][3] > 1:
                        done.append((*group[0][:2], [0, len(group[0][2]) - length + 1]))
                    group = []
                    if size > BUFFER:
                        yield from solve(ready)
                        ready, size = [], 0
                group.append(row)
            if done:
                yield _repeated_batch(done)
        if len(group) > 1:
            ready += group
        elif group and group[0][3] > 1:
            yield _repeated_batch([(*group[0][:2], [0, len(group[0][2]) - length + 1])])
        yield from solve(ready)

    return run


def _strings(length: int):
    """Every string of the bodies of a frequent anchor, by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            columns = [[], [], [], [], [], []]
            for anchor, name, body, times in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(body, np.uint8)
                one, two = (_rolled(raw, length, t).view(np.int64) for t in (_TABLE, _TABLE_2))
                n = len(one)
                values = (np.full(n, anchor), np.full(n, name), np.arange(n), one, two)
                for column, value in zip(columns, (*values, np.full(n, times))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in columns],
                names=["anchor", "name", "at", "one", "two", "times"],
            )

    return run


def _from_strings(bodies: DataFrame, length: int) -> DataFrame:
    """As `_sort_suffixes`, for anchors with very many bodies: counts strings one by one."""
    strings = bodies.select("anchor", "name", "body", "times").mapInArrow(
        _strings(length), "anchor long, name long, at long, one long, two long, times long"
    )
    often = (
        strings.groupBy("one", "two")
        .agg(F.sum("times").alias("n"))
        .where("n > 1")
        .select("one", "two")
    )
    hits = lookup_join(strings, often, ["one", "two"])
    ordered = F.array_sort(F.collect_list("at"))
    ones = F.transform(ordered, lambda i: F.array(i.cast("int"), (i + 1).cast("int")))
    return hits.groupBy("anchor", "name").agg(F.flatten(ones).alias("ranges"))


def _covered(length: int):
    """Texts with their repeated stretches to the spans of removed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = []
            for k1, k2, text, anchors, hits in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                repeated = {(h["anchor"], h["name"]): h["ranges"] for h in hits}
                change = np.zeros(len(raw) + 1, np.int32)
                for anchor, start, _, _, name in _bodies(text, np.array(anchors), length):
                    ranges = repeated.get((anchor, name), ())
                    for a, b in zip(ranges[::2], ranges[1::2]):
                        change[start + a] += 1
                        change[start + b + length - 1] -= 1
                edges = _ranges(np.cumsum(change[:-1]) > 0)
                rows.append((k1, k2, edges, *digest(raw, edges)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                names=["k1", "k2", "spans", "n_removed", "kept_sha256"],
            )

    return run


def digest(raw: bytes, edges: list[int]) -> tuple[int, str]:
    """Number of bytes within the edges and the hash of all others."""
    kept, at, removed = hashlib.sha256(), 0, 0
    for a, b in zip(edges[::2], edges[1::2]):
        kept.update(raw[at:a])
        removed, at = removed + b - a, b
    kept.update(raw[at:])
    return removed, kept.hexdigest()


def repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Texts of which something is repeated: ``k1, k2, spans, n_removed, kept_sha256``.

    ``spans`` lists begin and end of each removed run of bytes in turn; null means all.
    """
    rows = _with_keys(docs, id_col, text_col)
    long_rows = rows.where(F.col("n_bytes") >= length)
    anchors = (
        long_rows.select("text", "k1")
        .mapInArrow(_count_anchors(length), "anchor long, low long, high long")
        .groupBy("anchor")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low != high")
        .select("anchor")
    )
    listed = long_rows.select("text", "k1", "k2").mapInArrow(
        _list_anchors(length), "anchor long, k1 long, k2 long"
    )
    candidates = (
        lookup_join(listed, anchors, ["anchor"])
        .groupBy("k1", "k2")
        .agg(F.collect_set("anchor").alias("anchors"))
    )
    distinct = long_rows.groupBy("k1", "k2").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )
    open_texts = stored(distinct.join(candidates.hint("merge"), ["k1", "k2"]), "repeat-texts")
    found = stored(
        open_texts.select("k1", "k2", "text", "copies", "anchors").mapInArrow(
            _extract(length),
            "anchor long, name long, body binary, times long, k1 long, k2 long",
        ),
        "repeat-bodies",
    )
    bodies = found.groupBy("anchor", "name", "body").agg(F.sum("times").alias("times"))
    kinds = found.groupBy("anchor").agg(F.count_distinct("name").alias("n"))
    frequent = stored(kinds.where(F.col("n") > MANY).select("anchor"), "repeat-frequent")
    usual = bodies
    if frequent.limit(1).count():
        usual = bodies.join(frequent.hint("merge"), "anchor", "left_anti")
    repeated = (
        usual.repartition("anchor")
        .sortWithinPartitions("anchor")
        .select("anchor", "name", "body", "times")
        .mapInArrow(_sort_suffixes(length), _REPEATED)
    )
    if frequent.limit(1).count():
        many = bodies.join(frequent.hint("merge"), "anchor", "left_semi")
        repeated = repeated.unionByName(_from_strings(many, length))
    hits = (
        found.select("anchor", "name", "k1", "k2")
        .join(repeated.hint("merge"), ["anchor", "name"])
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("anchor", "name", "ranges")).alias("hits"))
    )
    some = (
        open_texts.where("copies = 1")
        .join(hits.hint("merge"), ["k1", "k2"])
        .select("k1", "k2", "text", "anchors", "hits")
        .mapInArrow(
            _covered(length),
            "k1 long, k2 long, spans array<long>, n_removed long, kept_sha256 string",
        )
    )
    whole = (
        long_rows.groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_removed"))
        .where("copies > 1")
        .select(
            "k1",
            "k2",
            F.lit(None).cast("array<long>").alias("spans"),
            "n_removed",
            F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"),
        )
    )
    return some.unionByName(whole)


def repeat_digests(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    rows = _with_keys(docs, id_col, text_col).drop("text")
    found = stored(repeats(docs, length, id_col, text_col), "repeats")
    joined = rows.join(found.hint("merge"), ["k1", "k2"], "left")
    spans = F.when(F.col("n_removed").isNull(), 0).otherwise(
        F.coalesce(F.size("spans") / 2, F.lit(1))
    )
    return joined.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        spans.cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def without_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated strings cut out of the texts.

    A character that is covered in part stays, so that the rest is valid text.
    """
    found = stored(repeats(docs, length, id_col, text_col), "repeats")
    keyed = _with_keys(docs, id_col, text_col)
    key, edges, hit = fresh(docs, "key", "edges", "hit")
    named = docs.withColumn(key, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    names = docs.columns
    spans = (
        keyed.select("k1", "k2", "sha")
        .distinct()
        .join(found.hint("merge"), ["k1", "k2"])
        .select(F.col("sha").alias(key), F.col("spans").alias(edges), F.lit(1).alias(hit))
    )
    joined = named.join(spans.hint("merge"), key, "left")

    @F.pandas_udf("string")
    def cut(text, spans):
        return pd.Series([_cut_characters(t, e) for t, e in zip(text, spans)], dtype=object)

    some = F.col(hit).isNotNull() & F.col(edges).isNotNull()
    # texts without hits do not go through Python
    body = F.when(some, cut(F.when(some, F.col(text_col)), F.when(some, F.col(edges))))
    kept = body.when(F.col(hit).isNotNull(), F.lit("")).otherwise(F.col(text_col))
    return joined.withColumn(text_col, kept).select(*names)


def _cut_characters(text, edges):
    if text is None or edges is None:
        return text
    raw, at, parts = text.encode(), 0, []
    for a, b in zip(edges[::2], edges[1::2]):
        a, b = int(a), int(b)
        while a < b and raw[a] & 0xC0 == 0x80:  # begins inside a character: keep it
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts).decode()
