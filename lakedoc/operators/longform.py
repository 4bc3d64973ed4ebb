"""Unpivoting many columns into few scans, the core of every counting operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import is_groupable, key_of, quoted

# Widest unpivot of one scan; bounds the generated code and the partial hash map.
COLUMNS_PER_SCAN = 64


@dataclass(frozen=True)
class Slot:
    """One key to count: its id, the frame it comes from, its class and SQL text."""

    id: int
    table: DataFrame
    key_class: str
    key: str


def column_type(df: DataFrame, name: str) -> T.DataType | None:
    """Type of the column called exactly ``name``; None if there is none."""
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    return None


def countable(df: DataFrame, name: str) -> bool:
    """Whether the column exists and its values can be compared."""
    kind = column_type(df, name)
    return kind is not None and is_groupable(kind)


def column_slot(slot_id: int, df: DataFrame, column: str, key=key_of) -> Slot:
    return Slot(slot_id, df, *key(quoted(column), column_type(df, column)))


def columns_slot(slot_id: int, df: DataFrame, columns: tuple[str, ...]) -> Slot:
    """Slot of several columns together; null where one of them is."""
    typed = [key_of(quoted(c), column_type(df, c)) for c in columns]
    if len(typed) == 1:
        return Slot(slot_id, df, *typed[0])
    complete = " AND ".join(f"{key} IS NOT NULL" for _, key in typed)
    packed = ", ".join(f"'k{i}', {key}" for i, (_, key) in enumerate(typed))
    name = "struct:" + ",".join(c for c, _ in typed)
    return Slot(slot_id, df, name, f"CASE WHEN {complete} THEN named_struct({packed}) END")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union of many frames, paired up so that the plan stays shallow."""
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0] if len(p) == 1 else p[0].unionByName(p[1]) for p in pairs]
    return frames[0]


def long_values(
    slots: list[Slot], columns_per_scan: int = COLUMNS_PER_SCAN
) -> dict[str, DataFrame]:
    """Per key class, the rows ``slot, value`` of all slots, from all their tables.

    A table is scanned once per class (in chunks if it is very wide), reading only
    the columns of that class; the scans of different tables are unioned, so that
    what follows shuffles once per class, not once per table or column.
    """
    scans: dict[str, dict[int, list[Slot]]] = {}
    for slot in slots:
        scans.setdefault(slot.key_class, {}).setdefault(id(slot.table), []).append(slot)
    classes = {}
    for name, tables in scans.items():
        frames = []
        for members in tables.values():
            for start in range(0, len(members), columns_per_scan):
                chunk = members[start : start + columns_per_scan]
                pairs = ", ".join(f"{s.id}, {s.key}" for s in chunk)
                frames.append(
                    chunk[0].table.selectExpr(f"stack({len(chunk)}, {pairs}) AS (slot, value)")
                )
        classes[name] = union_all(frames)
    return classes


def value_counts(classes: dict[str, DataFrame]) -> DataFrame:
    """One row per slot and distinct value: ``slot, is_null, n``.

    Equal values collapse on the map side before the shuffle, so a value that fills
    most of a table travels once per task.
    """
    return union_all(
        [
            long.groupBy("slot", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("slot", F.col("value").isNull().alias("is_null"), "n")
            for long in classes.values()
        ]
    )
