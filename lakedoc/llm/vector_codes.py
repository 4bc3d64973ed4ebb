"""Operator 11: vectors as short codes, one codebook index per part.

Method: memoised grid cells. Components become integers; a vector is cut into equal parts,
each of which has a codebook. The values of a part fall into a coarse grid cell (a box of
side ``2**CELL_BITS``). The first time a worker meets a cell it compares the box with all
entries: an entry whose least distance to the box is larger than another's largest is
dominated for every point in it; the others are cached for the cell. Only those are
evaluated exactly, in integers, for every point of the cell (ties go to the lower index,
which the cache keeps: domination is strict).

Plan: a codebook (``64 * width`` integers) is the only thing that the driver holds and the
tasks receive. A round is one scan: every task assigns its rows, adds up its parts per
entry and sends at most one row per entry and component position to a grouped sum. The
last scan writes the codes; the errors of equal labels are summed from those (partially in
the map tasks) and go back by an equi-join with one row per label. Vectors never move.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped; a shorter vector counts as if zeros followed up to the longest one, and the width
as if they followed up to a multiple of the number of parts, which adds nothing to any
distance. Integers are limited so that all distances of a vector fit 63 bits (for 64
components: to 2**27 either way, components of half a million). Null ids rank after all
others; repeated ids are rows of their own, among which the smaller vector comes first;
fewer rows than entries give smaller codebooks; an empty table gives no rows; further
columns are ignored. A sum of errors beyond 63 bits is given as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedoc.operators.joins import lookup_join

from .common import slices, stored, worker_state
from .vectors import clean, matrix, width

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
CELL_BITS = 5
MAX_CELLS = 1 << 16  # of one part in the memory of a worker; then its cache starts anew

_SUMS = "part int, entry int, place int, total long, n long"
_CODED = "vec_id long, label string, code string, error long"


def padded(wide: int, parts: int) -> int:
    return -(-wide // parts) * parts


def limit_of(wide: int) -> int:
    """The largest integer component, a power of two: ``wide * (2 * limit)**2 <= 2**62``."""
    return 1 << (30 - max(0, (max(wide, 1) - 1).bit_length() + 1) // 2)


def integers(vectors: np.ndarray, limit: int) -> np.ndarray:
    """``floor(SCALE * x)`` of every component, within the limit."""
    return np.clip(np.floor(vectors * SCALE), -limit, limit).astype(np.int64)


class Cells:
    """Entries that can be nearest to some point of a coarse cell, for one codebook of one part."""

    def __init__(self, codebook: np.ndarray, bits: int = CELL_BITS, most: int = MAX_CELLS):
        self.codebook, self.bits, self.most = codebook, bits, most
        self.known: dict[bytes, int] = {}
        self.kept: list[np.ndarray] = []

    def candidates(self, cell: np.ndarray) -> np.ndarray:
        """Indexes of the entries that no other entry dominates in the cell, ascending."""
        low = cell << self.bits
        high = low + (1 << self.bits) - 1
        below, above = low - self.codebook, self.codebook - high
        outside = np.maximum(np.maximum(below, above), 0)
        furthest = np.maximum(np.abs(self.codebook - low), np.abs(self.codebook - high))
        least, most = (outside**2).sum(1), (furthest**2).sum(1)
        return np.flatnonzero(least <= most.min())

    def _number(self, cell: np.ndarray) -> int:
        key = cell.tobytes()
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.kept)
            self.kept.append(self.candidates(cell))
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every point the index of its nearest entry, and the squared distance."""
        if len(self.kept) > self.most:
            self.known, self.kept = {}, []
        cells, of_point = np.unique(points >> self.bits, axis=0, return_inverse=True)
        of_point = of_point.reshape(-1)
        lists = [self.kept[self._number(cell)] for cell in cells]
        sizes = np.array([len(some) for some in lists])
        index = np.empty(len(points), np.int64)
        error = np.empty(len(points), np.int64)
        for size in np.unique(sizes):  # cells with as many candidates are evaluated together
            chosen = np.flatnonzero(sizes == size)
            place = np.full(len(cells), -1)
            place[chosen] = np.arange(len(chosen))
            rows = np.flatnonzero(place[of_point] >= 0)
            entries = np.stack([lists[i] for i in chosen])[place[of_point[rows]]]
            apart = ((points[rows, None, :] - self.codebook[entries]) ** 2).sum(2)
            first = apart.argmin(1)  # the lowest of equal ones
            here = np.arange(len(rows))
            index[rows], error[rows] = entries[here, first], apart[here, first]
        return index, error


def _codebooks(key: str, books: np.ndarray) -> list[Cells]:
    """The caches of this worker for these codebooks, which replace those of earlier ones."""
    held = worker_state("vector_cells", dict)
    if key not in held:
        held.clear()
        held[key] = [Cells(book) for book in books]
    return held[key]


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _assigned(books: np.ndarray, cells: list[Cells], vectors: pa.Array):
    """Integers by row and part; by part and row the nearest entry and its error."""
    parts, _, wide = books.shape
    total = parts * wide
    ints = integers(matrix(vectors, total), limit_of(total))
    points = ints.reshape(len(ints), parts, wide)
    found = [cells[part].nearest(points[:, part]) for part in range(parts)]
    return points, np.stack([f[0] for f in found]), np.stack([f[1] for f in found])


def _sums(books: np.ndarray):
    parts, entries, wide = books.shape
    key = digest(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, wide), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        cells = _codebooks(key, books)
        for batch in slices(batches, 4096):
            points, index, _ = _assigned(books, cells, batch.column(0))
            for part in range(parts):
                np.add.at(totals[part], index[part], points[:, part])
                counts[part] += np.bincount(index[part], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            place = np.tile(np.arange(wide), len(part))
            columns = [
                np.repeat(part, wide).astype(np.int32),
                np.repeat(entry, wide).astype(np.int32),
                place.astype(np.int32),
                totals[part, entry].ravel(),
                np.repeat(counts[part, entry], wide),
            ]
            names = ["part", "entry", "place", "total", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _codes(books: np.ndarray):
    digits = np.array([f"{i:02x}" for i in range(256)])
    key = digest(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _codebooks(key, books)
        for batch in slices(batches, 4096):
            _, index, error = _assigned(books, cells, batch.column(2))
            code = ["".join(row) for row in digits[index.T].tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code), pa.array(error.sum(0))],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def first_codebooks(rows: DataFrame, wide: int, parts: int, entries: int) -> np.ndarray:
    """``parts, entries, components``: the parts of the rows with the smallest ids."""
    seeds = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector")
    vectors = [row.vector for row in seeds.limit(entries).collect()]
    table = matrix(pa.array(vectors, pa.list_(pa.float64())), wide)
    ints = integers(table, limit_of(wide))
    return np.ascontiguousarray(ints.reshape(len(ints), parts, wide // parts).transpose(1, 0, 2))


def next_codebooks(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floored mean of its parts; unused entries stay."""
    sums = rows.select("vector").mapInArrow(_sums(books), _SUMS)
    means = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = books.copy()
    for part, entry, place, total, n in means.collect():  # as many as the codebooks have numbers
        moved[part, entry, place] = total // n
    return moved


def compress(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Per usable row ``vec_id, code, error, label_error, codebooks_sha256``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = clean(table, id_col, vector_col, label_col).withColumn("label", F.col(label_col).cast("string"))
    wide = padded(max(width(rows), 1), parts)
    books = first_codebooks(rows, wide, parts, entries)
    if not books.shape[1]:
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return table.sparkSession.createDataFrame([], empty)
    for _ in range(rounds):
        books = next_codebooks(rows, books)
    coded = stored(rows.select("vec_id", "label", "vector").mapInArrow(_codes(books), _CODED), "codes")
    keyed = coded.select(
        "vec_id",
        "code",
        "error",
        F.coalesce("label", F.lit("")).alias("label_key"),
        F.col("label").isNull().alias("no_label"),
    )
    largest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = F.sum(F.col("error").cast("decimal(28,0)")).cast("decimal(38,0)")
    errors = keyed.groupBy("label_key", "no_label").agg(F.least(total, largest).cast("long").alias("label_error"))
    return lookup_join(keyed, errors, ["label_key", "no_label"]).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _sql_round(before: str, name: str) -> str:
    """SQL of one round: parts assigned to the codebooks ``before``, and the means ``name``."""
    return f"""
{name}_near AS (
  SELECT vec_id, part, arg_min(entry, apart * 64 + entry) AS entry
  FROM (SELECT p.vec_id, p.part, b.entry,
               list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p.v, b.v)])::BIGINT AS apart
        FROM pieces p JOIN {before} b USING (part))
  GROUP BY vec_id, part),
{name}_mean AS (
  SELECT part, entry, list(m ORDER BY place) AS v FROM (
    SELECT part, entry, place, floor_div(sum(x)::BIGINT, count(*)) AS m FROM (
      SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS place
      FROM {name}_near JOIN pieces USING (vec_id, part))
    GROUP BY part, entry, place)
  GROUP BY part, entry),
{name} AS (SELECT part, entry, coalesce(m.v, b.v) AS v
           FROM {before} b LEFT JOIN {name}_mean m USING (part, entry))"""


ORACLE_SQL = """
WITH kept AS (
  SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
pieces AS (
  SELECT vec_id, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS v
  FROM (SELECT vec_id, v, unnest(range(16)) AS part FROM kept)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept
          ORDER BY vec_id LIMIT 64),
b0 AS (SELECT part, entry, v FROM seeds JOIN pieces USING (vec_id)),
{round1},
{round2},
last AS (
  SELECT vec_id, part, arg_min(entry, apart * 64 + entry) AS entry, min(apart) AS apart
  FROM (SELECT p.vec_id, p.part, b.entry,
               list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p.v, b.v)])::BIGINT AS apart
        FROM pieces p JOIN b2 b USING (part))
  GROUP BY vec_id, part),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error
  FROM last GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error,
       (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
""".format(round1=_sql_round("b0", "b1"), round2=_sql_round("b1", "b2")).replace(
    "floor_div(sum(x)::BIGINT, count(*))",  # floors go down, also below zero
    "((sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT",
)
