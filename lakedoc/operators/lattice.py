"""Keys of several columns, found by walking up the lattice of column sets.

A set is looked at only if none of its subsets is a key and it can be one at all:

* no column of it has a null;
* the product of the distinct values of its columns reaches the number of rows (a single
  column's are sketched; a sketch counts with six standard deviations more);
* no two rows agree on it among those of one bucket of the values of one of its columns. Rows
  that agree share that bucket, so a set that has many such rows shows some there. A bucket
  serves all sets with its column. It rules out for certain.

What is left, the keys and sets with hardly a row to spare, is decided over all rows by hashes:
rows that agree have one hash, so only rows whose hash repeats are compared by their values.
The hashes travel sorted, as packed differences of a few bytes each. Rows that agree on a set
agree on every subset, so sets that share a subset with few repeats share its hashes.

Sketches are a fixed number of bytes each; a key is missed only where the sketches of its
columns fall six standard deviations short.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import key_of, quoted
from ..schemas import local_frame
from .longform import column_type, columns_slot, countable, long_values, union_all, value_counts
from .profile import DEVIATIONS

LG_K = 14  # of the sketches: 2**LG_K registers
SETS_PER_SCAN, SCANS_PER_JOB = 64, 16
BUCKETS = 64  # one of them is looked at before all rows are
LEAST_ROWS, MOST_ROWS = 2**12, 2**18  # in one bucket: small tables have fewer buckets, large ones more
SETS_PER_HASHING = 8  # sorted side by side in a task
HASHED_ROWS = 2**20  # of a task that are sorted at once, and of a part that are compared
REPEATS = 2**18  # hashes of a set that are kept; a shared subset should have a quarter of them
COMPARED = 2**12  # hashes of a set itself that are looked at: if more repeat, rows agree in these

Columns = tuple[str, ...]

_HASHED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _sketched(df: DataFrame, sets: list[Columns], lg_k: int, per_scan: int) -> dict[Columns, float]:
    """Distinct combinations of each set, as sketched."""
    keys = {c: key_of(quoted(c), column_type(df, c))[1] for s in sets for c in s}
    rows = []
    for start in range(0, len(sets), per_scan):
        part = sets[start : start + per_scan]
        hashed = [f"xxhash64({', '.join(keys[c] for c in columns)})" for columns in part]
        row = df.selectExpr(
            *[f"hll_sketch_estimate(hll_sketch_agg({h}, {lg_k})) AS d{i}" for i, h in enumerate(hashed)]
        )
        values = ", ".join(f"{start + i}, d{i}" for i in range(len(part)))
        rows.append(row.selectExpr(f"stack({len(part)}, {values}) AS (id, n)"))
    jobs = [union_all(rows[i : i + SCANS_PER_JOB]) for i in range(0, len(rows), SCANS_PER_JOB)]
    return {sets[id_]: n for job in jobs for id_, n in job.collect()}  # one number per set


def _code(df: DataFrame, column: str) -> str:
    """SQL of a hash of the column's values, unlike that of other columns' equal values."""
    return f"xxhash64({df.columns.index(column)}, {key_of(quoted(column), column_type(df, column))[1]})"


def _hashable(kind: T.DataType) -> bool:
    """Whether equal values of the type have one hash; with a collation they may have two."""
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _hashable(kind.keyType) and _hashable(kind.valueType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return kind == T.StringType() or isinstance(kind, _HASHED)


def _agreeing(df: DataFrame, rows: DataFrame, sets: list[Columns], first: str | None = None) -> DataFrame:
    """``slot, n``: how often rows agree on a set, where they do.

    ``rows`` are rows of ``df`` with their keys, see `_keys`. ``first`` is a column of all
    sets by whose values they are dealt already.
    """
    names = sorted({c for columns in sets for c in columns}, key=df.columns.index)
    keys = ["slot"]
    for c in names:
        slots = [i for i, columns in enumerate(sets) if c in columns]
        key = f"k{df.columns.index(c)}"
        inside = f"CASE WHEN slot IN ({', '.join(map(str, slots))}) THEN {key} END AS {key}"
        keys.append(key if c == first else inside)
    slots = F.explode(F.array(*[F.lit(i) for i in range(len(sets))])).alias("slot")
    long = rows.select("*", slots).selectExpr(*keys)
    grouped = long.groupBy(*long.columns).agg(F.count(F.lit(1)).alias("n"))
    return grouped.where("n > 1").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def _keys(df: DataFrame, columns: set[str]) -> list[str]:
    """The keys of the columns as ``k`` and their place in the table."""
    found = sorted((df.columns.index(c), c) for c in columns)
    return [f"{key_of(quoted(c), column_type(df, c))[1]} AS k{i}" for i, c in found]


def _dealt_by(sets: list[Columns], most: dict[Columns, float]) -> dict[str, list[Columns]]:
    """The sets by one column of each, few columns in all, rather those with many values."""
    left, found = list(sets), {}
    while left:
        best = [max(some, key=lambda c: most[(c,)]) for some in left]
        column = max(set(best), key=lambda c: (best.count(c), most[(c,)], c))
        served = [column in some and 16 * most[(column,)] >= most[(b,)] for some, b in zip(left, best)]
        found[column] = [some for some, yes in zip(left, served) if yes]
        left = [some for some, yes in zip(left, served) if not yes]
    return found


def _buckets_taken(df: DataFrame, columns: list[str], n_rows: int, buckets: int) -> dict[str, int]:
    """Of each column a bucket of about average size, as that of a hot value is most of the table."""
    codes = [f"{i}, pmod({_code(df, c)}, {buckets})" for i, c in enumerate(columns)]
    sizes = df.selectExpr(f"stack({len(codes)}, {', '.join(codes)}) AS (slot, bucket)").groupBy("slot", "bucket")
    off = F.abs(F.col("count") - n_rows / buckets)
    best = F.min(F.struct(off.alias("off"), "bucket", "count")).alias("best")
    found = sizes.count().groupBy("slot").agg(best).select("slot", "best.*").collect()  # a row per column
    largest = max(MOST_ROWS, 4 * n_rows / buckets)
    return {columns[slot]: bucket for slot, _, bucket, n in found if n <= largest}


def _repeated(
    df: DataFrame, sets: list[Columns], most: dict[Columns, float], n_rows: int, per_scan: int, buckets: int
) -> dict[Columns, int]:
    """Those of the sets that have rows that agree in one bucket, with about how often any do."""
    jobs, order = [], []

    def look(rows: DataFrame, some: list[Columns], column: str | None = None) -> None:
        for start in range(0, len(some), per_scan):
            part = some[start : start + per_scan]
            keyed = rows.selectExpr(*_keys(df, {c for columns in part for c in columns}))
            if column is not None:
                keyed = keyed.repartition(F.col(f"k{df.columns.index(column)}"))
            found = _agreeing(df, keyed, part, first=column)
            jobs.append(found.select((F.col("slot") + len(order)).alias("slot"), "n"))
            order.extend(part)

    if buckets == 1:
        look(df, sets)
    else:
        dealt = _dealt_by(sets, most)
        taken = _buckets_taken(df, list(dealt), n_rows, buckets)
        for column, some in dealt.items():
            if column in taken:
                look(df.where(f"pmod({_code(df, column)}, {buckets}) = {taken[column]}"), some, column)
    repeated = {}
    for start in range(0, len(jobs), SCANS_PER_JOB):
        for slot, n in union_all(jobs[start : start + SCANS_PER_JOB]).collect():  # one number per set
            repeated[order[slot]] = n * buckets
    return repeated


def _sorter(members: list[list[int]], bits: int, part_bits: int, rows: int):
    """Rows of codes become the hashes of each set, sorted and packed part by part.

    The hash of a set is the exclusive or of the codes of its columns, of which the upper
    ``bits`` are kept; the upper ``part_bits`` of these number the part. A part is packed as
    the differences of its hashes, the first bytes of all, then the second, and so on.
    """

    def packed(slot: int, hashes: np.ndarray) -> Iterator[dict]:
        starts = np.arange(1 << part_bits, dtype=np.uint64) << np.uint64(bits - part_bits)
        bounds = [*np.searchsorted(hashes, starts), len(hashes)]
        for part, (low, high) in enumerate(zip(bounds, bounds[1:])):
            if low < high:
                gaps = np.diff(hashes[low:high], prepend=starts[part]).astype("<u8")
                width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
                planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
                body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
                yield {"slot": slot, "part": part, "n": int(high - low), "width": width, "body": body}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((name, pa.int32()) for name in ("slot", "part", "n", "width")), ("body", pa.binary())])
        kept: list[list[np.ndarray]] = [[] for _ in members]
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for slot, pieces in enumerate(kept):
                hashes = np.sort(np.concatenate(pieces))
                pieces.clear()
                again = hashes[1:] == hashes[:-1]
                for some in (hashes[np.append(True, ~again)], np.unique(hashes[1:][again])):  # each once
                    if rows_of := list(packed(slot, some)):
                        yield pa.RecordBatch.from_pylist(rows_of, schema=schema)

        for batch in batches:
            codes = [column.to_numpy(zero_copy_only=False).view(np.uint64) for column in batch.columns]
            for pieces, columns in zip(kept, members):
                whole = codes[columns[0]]
                for c in columns[1:]:
                    whole = whole ^ codes[c]
                pieces.append(whole >> np.uint64(64 - bits))
            held += batch.num_rows
            if held >= rows:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    return run


def _comparer(bits: int, part_bits: int, most: int):
    """The packed hashes of a part of a set become those that more than one of them holds."""

    def run(key: tuple, packed: pa.Table) -> pa.Table:
        slot, part = (k.as_py() for k in key)
        start = np.uint64(part << (bits - part_bits))
        pieces = []
        for row in packed.select(["n", "width", "body"]).to_pylist():
            planes = pa.decompress(row["body"], row["n"] * row["width"], codec="zstd", asbytes=True)
            gaps = np.zeros((row["n"], 8), np.uint8)
            gaps[:, : row["width"]] = np.frombuffer(planes, np.uint8).reshape(row["width"], -1).T
            pieces.append(np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64) + start)
        hashes = np.sort(np.concatenate(pieces))
        again = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
        schema = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])
        row = {"slot": slot, "n": len(again), "body": again[:most].astype("<i8").tobytes()}
        return pa.Table.from_pylist([row], schema=schema)

    return run


def _bits(n_rows: int) -> int:
    """Of the hashes that are compared: so many that some thousand unlike rows share one."""
    return min(64, max(32, 2 * n_rows.bit_length() - 12))


def _part_bits(n_rows: int) -> int:
    """Of the number of a part, which holds at most about twice `HASHED_ROWS`."""
    return max(0, n_rows.bit_length() - HASHED_ROWS.bit_length())


def _packed(df: DataFrame, sets: list[Columns], n_rows: int) -> DataFrame:
    """The hashes of all rows, of each set, as `_sorter` packs them."""
    names = sorted({c for columns in sets for c in columns}, key=df.columns.index)
    members = [[names.index(c) for c in columns] for columns in sets]
    codes = df.selectExpr(*[f"{_code(df, c)} AS c{i}" for i, c in enumerate(names)])
    run = _sorter(members, _bits(n_rows), _part_bits(n_rows), HASHED_ROWS)
    return codes.mapInArrow(run, "slot int, part int, n int, width int, body binary")


def _hash_repeats(df: DataFrame, sets: list[Columns], n_rows: int) -> dict[Columns, tuple[np.ndarray, bool]]:
    """The hashes that more than one row has, of each set, and whether these are all of them."""
    part_bits = _part_bits(n_rows)
    run = _comparer(_bits(n_rows), part_bits, max(1, REPEATS >> part_bits))
    parts = _packed(df, sets, n_rows).groupBy("slot", "part")
    found = parts.applyInArrow(run, "slot int, n long, body binary")
    repeats: dict[int, list[np.ndarray]] = {i: [] for i in range(len(sets))}
    counts = [0] * len(sets)
    for slot, n, body in found.where("n > 0").collect():  # at most REPEATS numbers per set
        repeats[slot].append(np.frombuffer(bytes(body), "<i8"))
        counts[slot] += n
    hashes = [np.concatenate([np.zeros(0, "<i8"), *pieces]) for pieces in repeats.values()]
    return {some: (kept, len(kept) == n) for some, kept, n in zip(sets, hashes, counts)}


def _rows_with(df: DataFrame, subset: Columns, hashes: np.ndarray, n_rows: int) -> DataFrame:
    """The rows with one of these hashes of the subset."""
    name = "h" + "_" * max(map(len, df.columns))  # no column has it
    whole = " ^ ".join(_code(df, c) for c in subset)
    hashed = df.withColumn(name, F.expr(f"shiftrightunsigned({whole}, {64 - _bits(n_rows)})"))
    asked = df.sparkSession.createDataFrame(pa.table({name: pa.array(hashes, pa.int64())}))
    return hashed.join(F.broadcast(asked), name, "left_semi").select(*map(quoted, df.columns))


def _refined(df: DataFrame, shared: dict[Columns, list[Columns]], n_rows: int) -> set[Columns]:
    """Those of the sets that tell all rows apart; they are listed by a subset, or by themselves.

    Only rows whose hash of the subset repeats can agree, and these are compared.
    """
    found = {some for sets in shared.values() for some in sets}
    subsets = list(shared)
    for start in range(0, len(subsets), SETS_PER_HASHING):
        part = subsets[start : start + SETS_PER_HASHING]
        repeats = _hash_repeats(df, part, n_rows)
        for some in part:
            hashes, whole = repeats[some]
            if shared[some] == [some]:
                repeats[some] = hashes[:COMPARED], whole and len(hashes) <= COMPARED
        alike = [some for some in part if len(repeats[some][0])]
        rows = {some: _rows_with(df, some, repeats[some][0], n_rows) for some in alike}
        lower = [some for some in alike if shared[some] != [some] and repeats[some][1]]
        counts = [rows[some].agg(F.lit(i).alias("i"), F.count(F.lit(1))) for i, some in enumerate(lower)]
        sizes = {lower[i]: n for i, n in union_all(counts).collect()} if counts else {}
        jobs, order = [], []
        for some in alike:
            sets = shared[some]
            if sets != [some] and some not in sizes:  # more hashes repeat than were kept
                found -= set(sets) - _exact(df, sets, n_rows)
            elif some in sizes and len(sets) * sizes[some] > max(MOST_ROWS, n_rows // 8):
                found -= set(sets) - _exact(rows[some], sets, sizes[some])
            else:  # few rows, or rows that mostly agree
                keyed = rows[some].selectExpr(*_keys(df, {c for columns in sets for c in columns}))
                agree = _agreeing(df, keyed, sets)
                jobs.append(agree.select((F.col("slot") + len(order)).alias("slot")))
                order += sets
        if jobs:
            found -= {order[slot] for (slot,) in union_all(jobs).collect()}  # one number per set
        for some in part:
            if shared[some] == [some] and some in found and not repeats[some][1]:
                found -= {some} - _counted(df, [some], n_rows)
    return found


def _counted(df: DataFrame, sets: list[Columns], n_rows: int) -> set[Columns]:
    """Those of the sets that tell all rows apart, by counting their distinct values."""
    found = set()
    for start in range(0, len(sets), SETS_PER_SCAN):
        part = sets[start : start + SETS_PER_SCAN]
        slots = [columns_slot(i, df, columns) for i, columns in enumerate(part)]
        counted = value_counts(long_values(slots)).groupBy("slot").agg(
            F.expr("count_if(NOT is_null)").alias("distincts")
        )
        found |= {part[slot] for slot, distincts in counted.collect() if distincts == n_rows}
    return found


def _exact(df: DataFrame, sets: list[Columns], n_rows: int) -> set[Columns]:
    """Those of the sets that tell all rows apart."""
    hashed = [some for some in sets if n_rows > MOST_ROWS and all(_hashable(column_type(df, c)) for c in some)]
    rest = [some for some in sets if some not in hashed]
    return _refined(df, {some: [some] for some in hashed}, n_rows) | _counted(df, rest, n_rows)


def _shared(df: DataFrame, sets: list[Columns], repeated: dict[Columns, int]) -> dict[Columns, list[Columns]]:
    """Subsets with few repeats, each with at least two of the sets that it serves."""
    served: dict[Columns, list[Columns]] = {}
    for some in sets:
        for part in (part for n in range(1, len(some)) for part in combinations(some, n)):
            if repeated.get(part, REPEATS) <= REPEATS // 4 and all(_hashable(column_type(df, c)) for c in part):
                served.setdefault(part, []).append(some)
    found = {}
    while served:
        best = max(served, key=lambda part: (len(served[part]), -repeated[part], part))
        if len(served[best]) < 2:
            break
        found[best] = taken = served.pop(best)
        served = {part: [some for some in left if some not in taken] for part, left in served.items()}
    return found


def composite_keys(
    df: DataFrame,
    table_name: str = "",
    max_columns: int = 3,
    *,
    columns: list[str] | None = None,
    lg_k: int = LG_K,
    sets_per_scan: int = SETS_PER_SCAN,
    buckets: int = BUCKETS,
) -> DataFrame:
    """All minimal keys of up to ``max_columns`` columns.

    ``table_name, column_names`` (in the order of the table, joined by commas),
    ``n_columns``. A set is a key if no row has a null in it and no two rows agree on it;
    it is minimal if no column can be left out. Columns whose values cannot be compared
    belong to none; a table without rows has none. ``columns`` limits the search. Jobs run
    when it is called, as each level depends on the one below.
    """
    names = [c for c in df.columns if (columns is None or c in columns) and countable(df, c)]
    counts = df.selectExpr("count(1) AS n", *[f"count({quoted(c)}) AS c{i}" for i, c in enumerate(names)])
    n_rows, *filled = counts.first()
    keys: set[Columns] = set()
    if n_rows:
        usable = [c for c, n in zip(names, filled) if n == n_rows]
        buckets = max(1, min(buckets, n_rows // LEAST_ROWS), n_rows // MOST_ROWS)
        slack = 1 + DEVIATIONS * 1.04 / 2 ** (lg_k / 2)
        most: dict[Columns, float] = {(): 1}  # upper bounds of distinct combinations
        repeated: dict[Columns, int] = {}  # about how often rows agree
        for size in range(1, max_columns + 1):
            possible = []
            for some in combinations(usable, size):
                parts = (part for n in range(1, size) for part in combinations(some, n))
                if any(part in keys for part in parts):
                    continue
                rests = [(some[:i] + some[i + 1 :], (some[i],)) for i in range(size)]
                most[some] = min((most[rest] * most[one] for rest, one in rests if rest), default=n_rows)
                if most[some] >= n_rows:
                    possible.append(some)
            if size == 1:
                for some, n in _sketched(df, possible, lg_k, sets_per_scan).items():
                    most[some] = min(most[some], n * slack)
                possible = [some for some in possible if most[some] >= n_rows]
            if possible:
                shown = _repeated(df, possible, most, n_rows, sets_per_scan, buckets)
                left = [some for some in possible if some not in shown]
                if buckets == 1:  # all rows were looked at
                    keys |= set(left)
                    continue
                shared = _shared(df, left, repeated) if n_rows > MOST_ROWS else {}
                served = {some for sets in shared.values() for some in sets}
                alone = [some for some in left if some not in served]
                keys |= _exact(df, alone, n_rows) | _refined(df, shared, n_rows)
                repeated |= shown | {some: 0 for some in left if some not in keys}
    listed = [(table_name, ", ".join(some), len(some)) for some in sorted(keys)]
    return local_frame(df.sparkSession, listed, "table_name string, column_names string, n_columns int")
