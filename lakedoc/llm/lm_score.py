"""Operator 7: language-model scores by online logistic context mixing.

Method: see `mixing`. Several hashed-context predictors of single bits are combined by
gated weights, which go on adapting inside each text that is scored.

What is learned from what: the exact count of every token, the statistics of all
predictors, the codes, the initial weights and the refinement come from *all* training texts
(crc32(doc_id as text) mod 5 is not 1). Weights have to be fitted on texts that the tables do
not know: a hash parts the training texts into two halves with tables of their own, and each
half is read with the tables of the other. The final tables are the sum of both. The ``head``
most frequent words, of those seen twice or more, become symbols of their own.

Plan: tokens are counted in the map tasks, then per token and half. Each map task adds up its
own tables of 2**``bits`` slots for both halves, from the trigrams of its texts or, for what
depends on a word alone (its spelling), from rows of the token counts; the tables travel in
chunks that are summed one row at a time. A second pass over the training texts counts how often the predictors said
what, and what came (`mixing.tell`: at most 2**21 cells); the weights are fitted on these
counts. The model (codes and tables: a fixed size) is broadcast and one pass scores every
text. The base score needs the exact count of every token: those of the head are in the
model; the other words of each text join the count table, which has one row per word, and
are summed up per row. The scored table is stored before that, so its row numbers stand.

Defined results: null and empty texts are the end token alone; null ids belong to the
training texts; repeated ids are rows of their own; without training texts every decision
has probability one half and the base score is 0; an empty table gives no rows; further
columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing
from .common import slices, stored, texts

HEAD = 1 << 17
BITS = 21
BLOCK = 1_000_000  # bytes of text that are scored together, or one text
_POOL = 4 << 20  # bytes of text that are split together, or one text
_COUNTED = 16 << 20  # bytes of text whose words are counted together, or one text
_KEPT = 1_500_000  # tokens of which a task keeps trigrams before it counts them
_WORDS = 1 << 16  # rows of the word counts that are spelt together
_MOST = 1 << 30  # what a task counts before it passes its tables on
_CHUNK = 1 << 16  # counters that travel together


def tokens_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case; bytes split at the six ASCII spaces."""
    return text.encode().lower().split()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return texts(docs, id_col, text_col).select("doc_id", held.alias("held_out"), "text")


def _pools(
    batches: Iterator[pa.RecordBatch], column: int, much: int = _POOL
) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some bytes of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // much)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(sizes)]):
            if high > low:
                yield batch.slice(low, high - low)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of `tokens_of` and the ends, counted per slice: in all, and in the second half."""
    for batch in _pools(batches, 1, _COUNTED):
        half = batch.column(0).to_numpy().astype(np.int64)
        words, sizes = mixing.split(batch.column(1))
        words = words.dictionary_encode()
        at = words.indices.to_numpy().astype(np.int64) << 1
        at |= np.repeat(half, sizes)
        n = np.bincount(at, minlength=2 * len(words.dictionary)).reshape(-1, 2)
        n = np.concatenate([n, [[len(half) - half.sum(), half.sum()]]]).astype(np.int64)
        names = pa.concat_arrays([words.dictionary, pa.array([mixing.END_WORD], pa.binary())])
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(n.sum(1)), pa.array(n[:, 1].copy())], names=["word", "n", "other"]
        )


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(257, np.int64)  # the last one: the words themselves
    for batch in batches:
        for word, n in zip(*(c.to_pylist() for c in batch.columns)):
            total[:256] += n * np.bincount(np.frombuffer(word, np.uint8), minlength=256)
            total[256] += n
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(257)), pa.array(total)], names=["byte", "n"]
    )


def _blocks(batches: Iterator[pa.RecordBatch], code: mixing.Code, column: int):
    """Parts of the batches, as blocks of texts of like lengths, the longest first."""
    for pool in _pools(batches, column):
        sizes = pc.binary_length(pool.column(column)).to_numpy().astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        rows, bytes_of = pool.take(pa.array(order)), sizes[order]
        words, sizes = mixing.split(rows.column(column))
        known, ends = code.find(words), np.append(0, np.cumsum(sizes))
        cuts = np.flatnonzero(np.diff((np.cumsum(bytes_of) - bytes_of) // BLOCK)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(sizes)]):
            own = slice(ends[low], ends[high])
            block = mixing.Block.of(words[own], known[own], sizes[low:high], code)
            yield rows.slice(low, high - low), sizes[low:high], block


def _trigrams(batches: Iterator[pa.RecordBatch], code: mixing.Code):
    """Per half of the rows the trigrams of some millions of tokens."""
    kept: list[list] = [[], []]

    def met(half: int):
        parts = [np.concatenate(column) for column in zip(*kept[half])]
        kept[half].clear()
        return half, parts

    for pool in _pools(batches, 1):
        halves = pool.column(0).to_numpy()
        words, sizes = mixing.split(pool.column(1))
        known = code.find(words)
        for half in range(2):
            own = halves == half
            if own.any():
                found = mixing.trigrams(known[np.repeat(own, sizes)], sizes[own], code)
                kept[half].append([column.astype(np.int32) for column in found])
                if sum(len(part[0]) for part in kept[half]) > _KEPT:
                    yield met(half)
    yield from (met(half) for half in range(2) if kept[half])


def _words(batches: Iterator[pa.RecordBatch]):
    """Words of the count table, and how often each half has them: in all `_MOST` times at most."""

    def parts(words: pa.Array, times: np.ndarray):
        if times.sum() <= _MOST:
            yield words, times
        elif len(words) > 1:
            middle = len(words) // 2
            yield from parts(words[:middle], times[:, :middle])
            yield from parts(words[middle:], times[:, middle:])
        else:
            some = np.minimum(times, _MOST // 2)
            yield words, some
            yield from parts(words, times - some)

    for batch in slices(batches, _WORDS):
        n, other = (batch.column(k).to_numpy() for k in (1, 2))
        yield from parts(batch.column(0), np.stack([n - other, other]))


def _passed_on(into: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The tables that a task has counted, in chunks."""
    for half, context in np.ndindex(into.shape[:2]):
        for chunk, at in enumerate(range(0, into.shape[2], _CHUNK)):
            part = into[half, context, at : at + _CHUNK]
            if part.any():
                key = [pa.array([n], pa.int32()) for n in (context, chunk, half)]
                yield pa.RecordBatch.from_arrays(
                    [*key, pa.array([part.tobytes()], pa.binary())],
                    names=["context", "chunk", "half", "counts"],
                )


_CHUNKS = "context int, chunk int, half int, counts binary"


def _count_texts(shipped, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = mixing.Code.from_parts(*shipped.value)
        into = np.zeros((2, mixing.CONTEXTS, 2 << bits), np.int32)
        for half, met in _trigrams(batches, code):
            mixing.count_trigrams(*met, code, bits, into[half])
        yield from _passed_on(into)

    return run


def _count_spellings(shipped, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = mixing.Code.from_parts(*shipped.value)
        into, held = np.zeros((2, mixing.CONTEXTS, 2 << bits), np.int32), 0
        for words, times in _words(batches):
            if held + times.sum() > _MOST:
                yield from _passed_on(into)
                into[:], held = 0, 0
            held += times.sum()
            for half in range(2):
                mixing.count_words(words, times[half], code, bits, into[half])
        yield from _passed_on(into)

    return run


def _told(into: np.ndarray) -> pa.RecordBatch:
    told = np.flatnonzero(into)
    return pa.RecordBatch.from_arrays([pa.array(told), pa.array(into[told])], names=["told", "n"])


def _tell_texts(shipped, shipped_said, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, said = mixing.Code.from_parts(*shipped.value), shipped_said.value
        into = np.zeros(mixing.TOLD, np.int64)
        for half, met in _trigrams(batches, code):
            mixing.tell_trigrams(*mixing.distinct(*met, code), code, said[1 - half], bits, into)
        yield _told(into)

    return run


def _tell_spellings(shipped, shipped_said, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, said = mixing.Code.from_parts(*shipped.value), shipped_said.value
        into = np.zeros(mixing.TOLD, np.int64)
        for words, times in _words(batches):
            for half in range(2):
                mixing.tell_words(words, times[half], code, said[1 - half], bits, into)
        yield _told(into)

    return run


_TABLES = ["first", "second", "both"]


def _sum_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by context and chunk to one row each: predictors of each half and of both."""
    key, total = None, None

    def done() -> pa.RecordBatch:
        found = (total[0], total[1], total[0] + total[1])
        bodies = [mixing.predictors(counts[None])[0].tobytes() for counts in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()) for n in key] + [pa.array([b], pa.binary()) for b in bodies],
            names=["context", "chunk", *_TABLES],
        )

    for batch in batches:
        for context, chunk, half, counts in zip(*batch.columns):
            here, own = (context.as_py(), chunk.as_py()), np.frombuffer(counts.as_buffer(), np.int32)
            if here != key:
                if key is not None:
                    yield done()
                key, total = here, np.zeros((2, len(own)), np.int64)
            total[half.as_py()] += own
    if key is not None:
        yield done()


class Model:
    """Codes, predictors and weights, and the numbers of the base score."""

    def __init__(self, code, tables, weights, refine, bits, head_counts, ends, n_tokens, n_types):
        self.code, self.tables, self.weights, self.bits = code, tables, weights, bits
        self.refine = refine
        self.head_counts, self.ends = head_counts, ends
        self.n_tokens, self.n_types = n_tokens, n_types

    def parts(self) -> tuple:
        rest = (self.tables, self.weights, self.refine, self.bits, self.head_counts, self.ends)
        return self.code.parts(), *rest, self.n_tokens, self.n_types

    @classmethod
    def from_parts(cls, code: tuple, *rest) -> Model:
        return cls(mixing.Code.from_parts(*code), *rest)


def train(
    docs: DataFrame,
    *,
    head: int = HEAD,
    bits: int = BITS,
    fit_texts: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[Model, DataFrame]:
    """The model, and the exact count ``n`` of every training token ``word``.

    ``fit_texts`` has no effect any more: weights are fitted on all training texts.
    """
    spark = docs.sparkSession
    half = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).cast("int")
    rows = (
        _rows(docs, id_col, text_col)
        .where(~F.col("held_out"))
        .select(half.alias("half"), "text")
    )
    counts = stored(
        rows.mapInArrow(_count_words, "word binary, n long, other long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("other").alias("other")),
        "lm-counts",
    )
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_tokens, n_types = sums[0] or 0, sums[1]
    # words seen once stay outside, so that the escape is as likely as a new word is
    words = counts.where(
        (F.col("word") != F.lit(mixing.END_WORD))
        & (F.octet_length("word") <= 64)
        & (F.col("n") > 1)
    )
    top = words.orderBy(F.desc("n"), "word").limit(head).toArrow().sort_by(
        [("n", "descending"), ("word", "ascending")]
    )
    names, often = top["word"].to_pylist(), top["n"].to_numpy()
    ends = counts.where(F.col("word") == F.lit(mixing.END_WORD)).agg(F.sum("n")).first()[0] or 0
    all_bytes = (
        counts.where(F.col("word") != F.lit(mixing.END_WORD))
        .select("word", "n")
        .mapInArrow(_count_bytes, "byte long, n long")
        .groupBy("byte")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    byte_counts = np.zeros(257, np.int64)
    byte_counts[all_bytes["byte"].to_numpy()] = all_bytes["n"].to_numpy()
    for word, n in zip(names, often.tolist()):  # what is spelt: all words but the head's
        np.subtract.at(byte_counts, np.frombuffer(word, np.uint8), n)
        byte_counts[256] -= n
    code = mixing.Code.build(names, often, int(byte_counts[256]), int(ends), byte_counts[:256])
    shipped = spark.sparkContext.broadcast(code.parts())

    def fewer(df: DataFrame, by: int) -> DataFrame:  # fewer tables to add up
        return df.coalesce(max(1, df.rdd.getNumPartitions() // by))

    found = ", ".join(f"{name} binary" for name in _TABLES)
    summed = (
        fewer(rows, 4)
        .mapInArrow(_count_texts(shipped, bits), _CHUNKS)
        .union(fewer(counts, 8).mapInArrow(_count_spellings(shipped, bits), _CHUNKS))
        .repartition("context", "chunk")
        .sortWithinPartitions("context", "chunk")
        .mapInArrow(_sum_tables, f"context int, chunk int, {found}")
        .toArrow()
    )
    tables = np.zeros((len(_TABLES), mixing.CONTEXTS, 1 << bits), np.int16)
    width = min(_CHUNK, 2 << bits) // 2
    for context, chunk, *bodies in zip(*summed.columns):
        at = chunk.as_py() * width
        for table, body in zip(tables, bodies):
            table[context.as_py(), at : at + width] = np.frombuffer(body.as_buffer(), np.int16)
    del summed
    said = spark.sparkContext.broadcast([mixing.opinions(table) for table in tables[:2]])
    tables = tables[2].copy()
    told = (
        rows.mapInArrow(_tell_texts(shipped, said, bits), "told long, n long")
        .union(counts.mapInArrow(_tell_spellings(shipped, said, bits), "told long, n long"))
        .groupBy("told")
        .agg(F.sum("n").alias("n"))
        .orderBy("told")
        .toArrow()  # at most mixing.TOLD rows
    )
    said.unpersist()
    weights, refine = mixing.fit(
        told["told"].to_numpy(), told["n"].to_numpy(), mixing.initial_weights()
    )
    model = Model(code, tables, weights, refine, bits, often, int(ends), n_tokens, n_types)
    return model, counts.drop("other")


_SCORED = (
    "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double,"
    " score double, n_bytes long, rare array<struct<word:binary,times:long>>"
)
_RARE = [pa.field("word", pa.binary()), pa.field("times", pa.int64())]


def _listed(block: mixing.Block, n: int) -> pa.Array:
    """Per text the words outside the head, and how often it has them."""
    words = block.rare.dictionary_encode()
    kinds = max(len(words.dictionary), 1)
    keys = block.escaped_text * np.int64(kinds) + words.indices.to_numpy()
    found, times = np.unique(keys, return_counts=True)
    ends = np.searchsorted(found // kinds, np.arange(n + 1)).astype(np.int32)
    own = words.dictionary.take(pa.array(found % kinds)), pa.array(times.astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(own, fields=_RARE))


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.from_parts(*shipped.value)
        code = model.code
        below = model.n_tokens + 0.5 * (model.n_types + 1)
        of_head = np.log10((model.head_counts + 0.5) / below)
        of_end = math.log10((model.ends + 0.5) / below)
        for batch, sizes, block in _blocks(batches, code, 3):
            n = len(sizes)
            spent = mixing.cost(
                block, code, model.tables, model.bits, model.weights, refine=model.refine
            )
            owner = np.repeat(np.arange(n), sizes)
            there = block.known >= 0
            known = np.bincount(owner[there], minlength=n) + (1 if model.ends else 0)
            base = np.bincount(owner[there], of_head[block.known[there]], n) + of_end
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(sizes + 1),
                    pa.array(known.astype(np.int64)),
                    pa.array(base),
                    pa.array(-spent / math.log(10)),
                    pc.binary_length(batch.column(3)).cast(pa.int64()),
                    _listed(block, n),
                ],
                names=[part.split()[0] for part in _SCORED.split(", ")],
            )

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    total_bits, bits_per_byte``.

    ``score`` is the decimal logarithm of the probability of the tokens, ``total_bits`` their
    coding cost, and ``bits_per_byte`` that by the UTF-8 bytes of the text (null without any).
    """
    model, counts = train(docs, id_col=id_col, text_col=text_col, **options)
    shipped = docs.sparkSession.sparkContext.broadcast(model.parts())
    rows = _rows(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text"
    )
    scored = stored(rows.mapInArrow(_score(shipped), _SCORED), "lm-scored")
    below = float(model.n_tokens + 0.5 * (model.n_types + 1))
    one = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(below))
    rare = (
        scored.select("rid", F.explode("rare").alias("own"))
        .select("rid", F.col("own.word").alias("word"), F.col("own.times").alias("times"))
        .join(counts.hint("merge"), "word", "left")
        .groupBy("rid")
        .agg(
            F.sum(F.col("times") * one).alias("more"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"),
        )
    )
    return (
        scored.drop("rare")
        .join(rare.hint("merge"), "rid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
            F.lit(model.n_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
            "score",
            (F.col("score") * -math.log2(10)).alias("total_bits"),
            F.when(
                F.col("n_bytes") > 0, F.col("score") * -math.log2(10) / F.col("n_bytes")
            ).alias("bits_per_byte"),
        )
    )
