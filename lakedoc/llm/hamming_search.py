"""Operator 12: nearest vectors by multi-index hashing of learned binary codes.

Method: unit vectors are centred, projected on their main directions and rotated so that
the signs lose as little as possible (iterative quantisation); the signs are the code.
More bits than directions come from further rotations. A code is cut into substrings of 16
bits, each with its own index from substring to rows. If two codes differ in at most
``radius`` bits, they differ in at most ``radius // m`` bits in one of the first
``radius % m + 1`` of the ``m`` substrings, or in fewer in one of the others (pigeonhole).
So every query probes all substring values that near, which retrieves *every* code within
the radius; codes are then compared whole, and the rest is reranked by exact cosines.

The radius is measured, not guessed: `CALIBRATION` queries (those with the smallest hash)
are searched with the full radius, which is exact, and the radius covers the share
``recall`` of their true neighbours. Queries with fewer than ``k`` rows within it are
searched again with the full radius, so none gets less than it should.

Plan: rows of equal vectors become one with the ``k + 1`` smallest of their ids, all that
any answer can name; so copies cost nothing, however many there are, and are not compared
with each other. The rotation is learned from a bounded sample (`SAMPLE` vectors,
`COMPONENTS` numbers). Vectors are dealt into shards by hash, and the different query
vectors into blocks; a task gets one shard and one block, indexes the shard and returns at
most ``k + 1`` rows per query, of which a window takes the best. Every query then drops
itself from the answer of its vector. Shards and blocks have bounded sizes, so no task
grows with the table, and nothing but the rotation is sent to all. The queries meet all
rows in blocks, as the task is stated; how much of a shard a query touches depends on the
radius that the vectors need.

Defined results: vectors that are null, zero, empty or hold null or non-finite components
take no part, and a query that is such has no rows; a shorter vector counts as if zeros
followed. Rows are candidates of their own, also if ids repeat: a query leaves out only its
own row. Null ids are no queries and rank last among ties. With ``k`` candidates or fewer
all are returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakedoc.operators.joins import lookup_join

from .common import stored
from .vectors import clean, matrix

K, QUERY_EVERY = 5, 50
BITS, WORD = 64, 16
RECALL = 0.98
SAMPLE, COMPONENTS = 8192, 1 << 22  # of the rows that the rotation is learned from
CALIBRATION = 256  # queries that the radius is measured with
SHARD_COMPONENTS, BLOCK_COMPONENTS = 1 << 23, 1 << 22  # of the vectors in one task
TOGETHER = 1 << 21  # pairs of a query and a row that are probed together

_KEY = ["a", "b"]  # of a vector: two hashes, 128 bits together
_FOUND = "a long, b long, vec_id long, score double, same boolean, apart int"
_ON = np.bitwise_count(np.arange(1 << WORD, dtype=np.uint32)).astype(np.uint8)
_MASKS = np.argsort(_ON, kind="stable").astype(np.uint32)  # by number of bits


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaling by powers of two first keeps extreme ones exact."""
    exponent = np.frexp(np.abs(vectors).max(1, initial=0))[1]
    scaled = np.ldexp(vectors, -exponent[:, None])
    return scaled / np.sqrt((scaled**2).sum(1))[:, None]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for each start and size, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Codes:
    """A learned map from unit vectors to binary codes, as 16-bit words."""

    def __init__(self, mean: np.ndarray, directions: np.ndarray):
        self.mean, self.directions = mean, directions

    @classmethod
    def learn(cls, sample: np.ndarray, bits: int = BITS, steps: int = 30) -> Codes:
        mean = sample.mean(0)
        centred = sample - mean
        main = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        rng, parts, left = np.random.default_rng(7), [], bits
        while left > 0:
            base = main[:, : min(left, main.shape[1])]
            projected = centred @ base
            turn = np.linalg.qr(rng.standard_normal((base.shape[1],) * 2))[0]
            for _ in range(steps):
                signs = np.where(projected @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(signs.T @ projected)
                turn = v.T @ u.T
            parts.append(base @ turn)
            left -= base.shape[1]
        return cls(mean, np.concatenate(parts, 1))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """``rows, words`` of unsigned 16-bit numbers."""
        signs = (vectors - self.mean) @ self.directions >= 0
        return np.packbits(signs, axis=1).view(np.uint16)


class MultiIndex:
    """Rows by every substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = [self._part(codes[:, i]) for i in range(codes.shape[1])]

    @staticmethod
    def _part(words: np.ndarray):
        rows = np.argsort(words, kind="stable")
        keys, starts, counts = np.unique(words[rows], return_index=True, return_counts=True)
        place = np.full(1 << WORD, -1, np.int32)
        place[keys] = np.arange(len(keys))
        return rows, keys, starts, counts, place

    @staticmethod
    def _probed(part, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a key of the part that differ in at most ``radius`` bits."""
        _, keys, _, _, place = part
        ball = sum(comb(WORD, i) for i in range(radius + 1))
        if ball < len(keys):  # look up every variant
            slots = place[words.astype(np.uint32)[:, None] ^ _MASKS[:ball]]
            query, variant = np.nonzero(slots >= 0)
            return query, slots[query, variant]
        return np.nonzero(_ON[words[:, None] ^ keys] <= radius)  # fewer keys than variants

    def within(self, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a query code and a row whose codes differ in at most ``radius`` bits."""
        if radius >= codes.shape[1] * WORD:  # all rows
            return tuple(x.ravel() for x in np.indices((len(codes), len(self.codes))))
        near = np.zeros((len(codes), len(self.codes)), bool)
        share, extra = divmod(radius, len(self.parts))
        for i, part in enumerate(self.parts):
            allowed = share if i <= extra else share - 1
            if allowed < 0:
                continue
            query, key = self._probed(part, codes[:, i], allowed)
            rows, _, starts, counts, _ = part
            sizes = counts[key]
            near[np.repeat(query, sizes), rows[_runs(starts[key], sizes)]] = True
        query, row = np.nonzero(near)
        fits = self.apart(codes, query, row) <= radius
        return query[fits], row[fits]

    def apart(self, codes: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Numbers of differing bits."""
        wide = np.uint64 if codes.shape[1] % 4 == 0 else np.uint16
        differ = np.bitwise_count(codes.view(wide)[query] ^ self.codes.view(wide)[row])
        return differ.sum(1, dtype=np.int32)


def cosines(vectors: np.ndarray, others: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Cosines in double precision of the rows ``first`` of vectors and ``second`` of others.

    Each is added up component by component; unlike a matrix product, that gives equal
    pairs equal cosines wherever they stand.
    """
    scale = lambda rows: np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0))[1][:, None])
    found = [np.empty(0)]
    for start in range(0, len(first), 1 << 14):
        some = slice(start, start + (1 << 14))
        pair = (vectors[first[some]], others[second[some]])
        left, right = (np.ascontiguousarray(scale(rows).T) for rows in pair)
        dot, one, two = (np.zeros(left.shape[1]) for _ in range(3))
        for x, y in zip(left, right):
            dot += x * y
            one += x * x
            two += y * y
        found.append(dot / (np.sqrt(one) * np.sqrt(two)))
    return np.concatenate(found)


def _leading(rows: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the unit rows that can be among the ``k`` nearest by rough cosines, ties included."""
    if len(rows) <= k:
        return np.arange(len(rows))
    rough = rows @ query
    least = np.partition(rough, len(rows) - k)[len(rows) - k]
    return np.flatnonzero(rough >= least - 1e-9)  # rough values are right to many more digits


def _search(codes: Codes, wide: int, k: int, radius: int):
    """Worker function: one block of queries against one shard."""

    def nearest_rows(shard: pa.Table, block: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        """Arrays ``query, place in all ids, score, same vector, bits apart``; at most ``k`` a query."""
        vectors, asked = matrix(shard["vector"], wide), matrix(block["vector"], wide)
        normed, asked_normed = units(vectors), units(asked)
        index, asked_codes = MultiIndex(codes.of(normed)), codes.of(asked_normed)
        lists = shard["ids"].combine_chunks()
        starts = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
        ids, unnamed = _sortable(lists.flatten())
        together = max(1, TOGETHER // len(vectors))
        for start in range(0, len(asked), together):
            query, row = index.within(asked_codes[start : start + together], radius)
            query += start
            bounds = np.searchsorted(query, np.arange(start, min(start + together, len(asked)) + 1))
            chosen = np.concatenate([
                low + _leading(normed[row[low:high]], asked_normed[start + i], k)
                for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:]))
            ])
            query, row = query[chosen], row[chosen]
            score = cosines(vectors, asked, row, query)
            same = (vectors[row] == asked[query]).all(1)
            apart = index.apart(asked_codes, query, row)
            sizes = starts[row + 1] - starts[row]  # every vector stands for some ids
            place = _runs(starts[row], sizes)
            query, score, same, apart = (np.repeat(x, sizes) for x in (query, score, same, apart))
            order = np.lexsort((ids[place], unnamed[place], -score, query))
            first = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
            yield query[first], place[first], score[first], same[first], apart[first]

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        parts = list(nearest_rows(shard, block)) if shard.num_rows and block.num_rows else []
        if not parts:
            return pa.table({name: pa.array([], kind) for name, kind in _ARROW.items()})
        query, place, score, same, apart = (np.concatenate(column) for column in zip(*parts))
        ids = shard["ids"].combine_chunks().flatten()
        columns = [block[name].take(pa.array(query)) for name in _KEY]
        columns += [ids.take(pa.array(place)), pa.array(score), pa.array(same), pa.array(apart)]
        return pa.table(dict(zip(_ARROW, columns)))

    return run


def _sortable(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids with 0 for null, and whether they are null."""
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)


_ARROW = {
    "a": pa.int64(),
    "b": pa.int64(),
    "vec_id": pa.int64(),
    "score": pa.float64(),
    "same": pa.bool_(),
    "apart": pa.int32(),
}


class HammingIndex:
    """The different vectors of a table in shards, and the map to their codes.

    ``k`` is the number of rows that searches return at most.
    """

    def __init__(self, table: DataFrame, k: int, id_col="vec_id", vector_col="embedding", bits: int = BITS):
        rows = clean(table, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))
        hashes = [F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")]
        self.rows = rows.select("*", *hashes)
        self.k, self.bits = k, bits
        self.wide, self.size = rows.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
        if not self.size:
            return
        whole = -(-self.size * self.wide // SHARD_COMPONENTS)
        self.shards = max(whole, min(32, -(-self.size // 512)))
        of_vector = W.partitionBy(*_KEY, "vector").orderBy(F.asc_nulls_last("vec_id"))
        least = self.rows.withColumn("nth", F.row_number().over(of_vector)).where(F.col("nth") <= k)
        lists = least.groupBy(*_KEY, "vector").agg(F.collect_list(F.struct("nth", "vec_id")).alias("ids"))
        ids = F.transform(F.array_sort("ids"), lambda x: x["vec_id"])  # nulls stay
        shard = F.pmod("a", F.lit(self.shards)).cast("int")
        self.index = stored(lists.select(*_KEY, "vector", ids.alias("ids"), shard.alias("shard")), "vectors")
        most = min(SAMPLE, max(1, COMPONENTS // self.wide))
        sample = self.index.select("vector").orderBy(F.xxhash64(*_KEY), *_KEY).limit(most)
        self.codes = Codes.learn(units(matrix(sample.toArrow()["vector"], self.wide)), bits)

    def search(self, asked: DataFrame, n_asked: int, radius: int) -> DataFrame:
        """The ``k`` nearest rows within the radius: `_FOUND` columns and ``rank``.

        ``asked``: different vectors with their key; ``n_asked`` only sizes the blocks.
        """
        blocks = max(1, -(-n_asked * self.wide // BLOCK_COMPONENTS))
        block = F.pmod("b", F.lit(blocks)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        own = asked.select(*(F.col(c).alias(c) for c in (*_KEY, "vector")))  # not columns of the index
        queries = own.select("*", block.alias("block"), every(self.shards).alias("shard"))
        there = self.index.select("vector", "ids", "shard", every(blocks).alias("block"))
        dealt = [df.repartition(self.shards * blocks, "shard", "block") for df in (there, queries)]
        left, right = (df.groupBy("shard", "block") for df in dealt)
        found = left.cogroup(right).applyInArrow(_search(self.codes, self.wide, self.k, radius), _FOUND)
        order = W.partitionBy(*_KEY).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def radius(self, asked: DataFrame, recall: float) -> int:
        """The smallest radius that holds the share ``recall`` of the sampled true neighbours."""
        sample = asked.orderBy(F.xxhash64(*_KEY), *_KEY).limit(CALIBRATION)
        true = self.search(sample, CALIBRATION, self.bits).where("NOT same").select("apart").toArrow()["apart"]
        apart = np.sort(true.to_numpy())  # at most k * CALIBRATION numbers
        return int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) if len(apart) else 0


def nearest(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    query_every: int = QUERY_EVERY,
    recall: float = RECALL,
    bits: int = BITS,
) -> DataFrame:
    """Of every row whose id ``query_every`` divides the ``k`` nearest other rows."""
    index = HammingIndex(table, k + 1, id_col, vector_col, bits)  # a query finds itself, too
    if not index.size:
        empty = "query_id long, rank int, vec_id long, score double"
        return table.sparkSession.createDataFrame([], empty)
    queries = index.rows.where(F.col("vec_id") % query_every == 0)
    asked = stored(queries.select(*_KEY, "vector").distinct(), "queries")
    n_asked = asked.count()
    found = stored(index.search(asked, n_asked, index.radius(asked, recall)), "found")
    whole = found.where(F.col("rank") == k + 1).select(*_KEY)
    rest = asked.join(whole.hint("merge"), _KEY, "left_anti")
    n_rest = rest.count()
    if n_rest:  # too few rows within the radius
        again = index.search(rest, n_rest, bits)
        found = found.join(rest.select(*_KEY).hint("merge"), _KEY, "left_anti").unionByName(again)
    entry = F.struct("rank", "vec_id", "score", "same")
    answers = stored(found.groupBy(*_KEY).agg(F.array_sort(F.collect_list(entry)).alias("found")), "answers")
    joined = lookup_join(queries.select("vec_id", *_KEY), answers, _KEY, fresh=False)
    is_own = F.transform("found", lambda x: x["same"] & x["vec_id"].eqNullSafe(F.col("vec_id")))
    own = F.array_position(is_own, True)
    others = F.slice(F.filter("found", lambda x, i: i + 1 != own), 1, k)
    each = joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "row"))
    return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "row.vec_id", "row.score")
