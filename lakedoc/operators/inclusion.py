"""Foreign keys that nobody declared: columns whose values all occur in a unique column.

Two steps, both over all tables at once. *Signatures* rule pairs out: of every column the
smallest hashes of its values are kept, which are the same hashes whatever else it or
another column holds. If a value of the child is missing from the parent, it is likely
among those, and then the pair is dropped; a pair that holds is never dropped. *Masks*
decide the others exactly: rows are grouped by value, each value has a bit for every
column it occurs in, and the bits that all values of a column share (``bit_and``) name the
columns that include it. No pairs of rows or of columns are formed on the way, and a value
that fills a third of a table is one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import common_key_of, quoted
from ..schemas import local_frame
from .longform import Slot, column_type, countable, long_values, union_all

SIGNATURE = 256  # hashes kept of a column
# A column may be unique if so few of its rows lack a hash of their own (hashes can collide).
SLACK = 1e-6
_BITS = 63

_TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)
_PAIR = ["source_table", "source_column", "target_table", "target_column"]

_SIGNATURES = (
    "slot int, table_name string, column_name string, domain string,"
    " rows long, nulls long, distincts long, hashes array<bigint>"
)

Name = tuple[str, str]  # table and column


def _domain(value: str, data_type: T.DataType) -> tuple[str, str]:
    """Name of the domain in which columns are compared, and a hash of the value.

    Values that are equal in the sense of `common_key_of` have equal hashes.
    """
    if isinstance(data_type, T.NumericType):
        return "number", f"xxhash64(CAST({value} AS DOUBLE) + 0.0D)"
    if isinstance(data_type, _TIMES):
        return "time", f"xxhash64(unix_micros(CAST({value} AS TIMESTAMP)))"
    simple = data_type.simpleString()
    text = f"array_sort(map_entries({value}))" if isinstance(data_type, T.MapType) else value
    return simple, f"xxhash64({text})"


def signatures(tables: dict[str, DataFrame], size: int = SIGNATURE) -> DataFrame:
    """Per column ``table_name, column_name, domain, rows, nulls, distincts, hashes``.

    ``hashes`` are the smallest of the hashed values, ascending; ``distincts`` counts
    hashes and can fall short by a few where they collide. One scan per table and one
    shuffle serve all columns.
    """
    names = [(n, c) for n, df in tables.items() for c in df.columns if countable(df, c)]
    spark = next(iter(tables.values())).sparkSession
    slots, listed = [], []
    for i, (name, column) in enumerate(names):
        domain, hashed = _domain(quoted(column), column_type(tables[name], column))
        key = f"CASE WHEN {quoted(column)} IS NOT NULL THEN {hashed} END"
        slots.append(Slot(i, tables[name], "hash", key))
        listed.append((i, name, column, domain))
    inventory = local_frame(spark, listed, "slot int, table_name string, column_name string, domain string")
    if not slots:
        return inventory.selectExpr(
            "*", "0L AS rows", "0L AS nulls", "0L AS distincts", "CAST(array() AS array<bigint>) AS hashes"
        )
    grouped = long_values(slots)["hash"].groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = grouped.groupBy("slot").agg(
        F.sum("n").alias("rows"),
        F.expr("coalesce(sum(CASE WHEN value IS NULL THEN n END), 0L)").alias("nulls"),
        F.count("value").alias("distincts"),
    )
    # Both read all of ``grouped``, and no filter reaches below it: Spark groups only once for them.
    nth = F.row_number().over(W.partitionBy("slot").orderBy(F.asc_nulls_first("value")))
    least = grouped.withColumn("nth", nth).where(F.col("nth") <= size + 1)  # one may be null
    hashes = (
        least.groupBy("slot")
        .agg(F.array_sort(F.collect_list(F.expr("IF(value IS NULL, NULL, struct(value, n))"))).alias("kept"))
        .select("slot", F.slice("kept.value", 1, size).alias("hashes"))
    )
    # All three have one row per column.
    joined = inventory.join(F.broadcast(counts), "slot", "left").join(F.broadcast(hashes), "slot", "left")
    none = F.array().cast("array<bigint>")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("rows", "nulls", "distincts")}
    return joined.withColumns(zeros | {"hashes": F.coalesce("hashes", none)})


def _possible(found: DataFrame, size: int) -> dict[tuple[Name, Name], int]:
    """Pairs of a column and a perhaps unique one that the signatures do not rule out.

    With the number of rows that the second one has.
    """
    # One row per column, read by both sides: as a plan each would scan all tables for itself.
    found = local_frame(found.sparkSession, [tuple(r) for r in found.collect()], _SIGNATURES)
    side = lambda name: found.select(
        "domain", *[F.col(c).alias(f"{name}_{c}") for c in ("slot", "table_name", "column_name",
                                                            "rows", "nulls", "distincts", "hashes")]
    )
    children = side("c").where("c_distincts > 0")
    parents = side("p").where(
        f"p_nulls = 0 AND p_distincts > 0 AND p_rows - p_distincts <= {SLACK}D * p_rows"
    ).withColumn("known", F.expr(f"CASE WHEN p_distincts > {size} THEN element_at(p_hashes, -1) END"))
    # Beyond its largest kept hash nothing is known of a parent.
    missing = "size(array_except(filter(c_hashes, h -> known IS NULL OR h <= known), p_hashes))"
    pairs = (
        children.join(F.broadcast(parents), "domain")  # signatures: one row per column
        .where("c_slot != p_slot AND c_distincts <= p_distincts")
        .where(f"{missing} = 0")
        .select("c_table_name", "c_column_name", "p_table_name", "p_column_name", "p_rows")
    )
    return {((a, b), (c, d)): n for a, b, c, d, n in pairs.collect()}  # bounded by the schemas


def included(tables: dict[str, DataFrame], pairs: list[tuple[Name, Name]]) -> DataFrame:
    """Those of the pairs whose first column has values, all of which the second has, too.

    `_PAIR` columns with ``source_distinct`` and ``target_distinct``, all exact.
    """
    spark = next(iter(tables.values())).sparkSession
    slots: dict[tuple[Name, str, str], Slot] = {}

    def slot_of(one: Name, other: Name) -> int:
        own, theirs = (column_type(tables[name], column) for name, column in (one, other))
        key_class, key = common_key_of(quoted(one[1]), own, theirs)
        # a column has one slot for each way in which it is compared
        made = slots.setdefault(
            (one, key_class, key), Slot(len(slots), tables[one[0]], key_class, key)
        )
        return made.id

    listed = [(*child, *parent, slot_of(child, parent), slot_of(parent, child)) for child, parent in pairs]
    wanted = local_frame(
        spark, listed, ", ".join(f"{c} string" for c in _PAIR) + ", child int, parent int"
    )
    if not listed:
        return wanted.selectExpr(*_PAIR, "0L AS source_distinct", "0L AS target_distinct")
    words = range(-(-len(slots) // _BITS))

    def bit(word: int) -> Column:
        """The bits of ``slot`` in one word of the mask."""
        return F.expr(
            f"CASE WHEN slot DIV {_BITS} = {word} THEN shiftleft(1L, slot % {_BITS}) ELSE 0L END"
        )

    masks = union_all([
        long.where("value IS NOT NULL")
        .groupBy("value")
        .agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in words])
        .select([f"w{w}" for w in words])
        for long in long_values(list(slots.values())).values()
    ])
    of_slot = lambda slot: F.expr(
        f"getbit(element_at(array({', '.join(f'w{w}' for w in words)}), CAST(1 + {slot} DIV {_BITS} AS INT)), {slot} % {_BITS}) = 1"
    )
    alike = masks.groupBy(*masks.columns).agg(F.count(F.lit(1)).alias("n"))  # few different masks
    each = alike.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(slots) - 1))).alias("slot"))
    shared = (
        each.where(of_slot("slot"))
        .groupBy("slot")
        .agg(F.sum("n").alias("distincts"), *[F.bit_and(f"w{w}").alias(f"w{w}") for w in words])
    )
    # One row per slot on both sides of what follows.
    children = shared.withColumnRenamed("slot", "child").withColumnRenamed("distincts", "source_distinct")
    parents = shared.select(F.col("slot").alias("parent"), F.col("distincts").alias("target_distinct"))
    return (
        wanted.join(F.broadcast(children), "child")
        .where(of_slot("parent"))
        .join(F.broadcast(parents), "parent")
        .select(*_PAIR, "source_distinct", "target_distinct")
    )


def fk_candidates(tables: dict[str, DataFrame], size: int = SIGNATURE) -> DataFrame:
    """Pairs of a column and a unique column, of any tables, that includes all its values.

    ``source_table, source_column, target_table, target_column, source_distinct,
    target_distinct, coverage`` (the share of the parent's values that are referenced, a
    hint to which pairs are meant). Numbers of any types are compared with each other, and
    so are dates and times; texts with texts; other types with themselves. A column is
    unique if it has no null and all its values differ in the comparison. Columns without
    values refer to nothing. A job runs when it is called: what is compared exactly depends
    on the signatures.
    """
    pairs = _possible(signatures(tables, size), size)
    found = included(tables, list(pairs))
    sizes = local_frame(
        found.sparkSession,
        [(*parent, n) for (_, parent), n in pairs.items()],
        "target_table string, target_column string, target_rows long",
    ).distinct()
    unique = found.join(F.broadcast(sizes), ["target_table", "target_column"])  # one row per pair
    coverage = F.col("source_distinct") / F.col("target_distinct")
    return (
        unique.where("target_distinct = target_rows")
        .select(*_PAIR, "source_distinct", "target_distinct")
        .withColumn("coverage", coverage)
    )
