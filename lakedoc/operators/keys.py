"""Foreign keys: from metadata extracts, and their verification against the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import common_key_of, quoted
from ..functions.ratios import null_ratio
from ..schemas import local_frame
from .columns import constraint_key
from .joins import lookup_join
from .longform import Slot, column_type, long_values, union_all

_CONSTRAINT = ["source", "table_schema", "constraint_name"]


def _pairs(*columns: Column) -> list[Column]:
    names = ["source_table", "source_column", "target_table", "target_column"]
    return [c.alias(n) for c, n in zip(columns, names)]


def _names(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ", ").alias(column)


def foreign_keys(
    constraints: DataFrame,
    key_usage: DataFrame,
    ref_usage: DataFrame,
    schema: str | None = None,
) -> DataFrame:
    """FKS rows (with ``source, table_schema``) from the three catalog extracts.

    Columns of a composite key are paired by position: the child's
    ``position_in_unique_constraint``, or else its ``ordinal_position``, with the parent's
    ``ordinal_position``. Without positions the pairing is unknown; such a key is one row
    that lists the columns of each side, in order of name. A constraint name may occur on
    several tables: where the constraints name the table it tells the keys apart, and the
    parent extract may carry the child's name as ``constraint_table``. Without that, keys
    of one name are paired across their tables; `ambiguous_keys` lists them.
    """
    keys = constraints.filter(F.col("constraint_type") == "FOREIGN KEY")
    if schema is not None:
        keys = keys.filter(F.col("table_schema") == schema)
    key = constraint_key(constraints)
    child = lookup_join(key_usage, keys.select(*key).distinct(), key, "left_semi")
    places = [
        c for c in ("position_in_unique_constraint", "ordinal_position") if c in child.columns
    ]
    paired = bool(places) and "ordinal_position" in ref_usage.columns
    on, own = list(_CONSTRAINT), []
    if "constraint_table" in ref_usage.columns:
        on, own = [*on, "child"], [F.col("constraint_table").alias("child")]
    child = child.select(
        *_CONSTRAINT,
        F.col("table_name").alias("child"),
        F.col("column_name").alias("child_column"),
        *([F.coalesce(*places).alias("place")] if paired else []),
    )
    parent = ref_usage.select(
        *_CONSTRAINT,
        *own,
        F.col("table_name").alias("parent"),
        F.col("column_name").alias("parent_column"),
        *([F.col("ordinal_position").alias("place")] if paired else []),
    )
    if paired:
        on = [*on, "place"]
    else:  # a few columns a key
        child = child.groupBy(*_CONSTRAINT, "child").agg(_names("child_column"))
        parent = parent.groupBy(*on, "parent").agg(_names("parent_column"))
    return child.join(parent, on).select(
        "source",
        "table_schema",
        *_pairs(*map(F.col, ("child", "child_column", "parent", "parent_column"))),
    )


def ambiguous_keys(key_usage: DataFrame, ref_usage: DataFrame) -> DataFrame:
    """Keys that the extracts cannot tell apart: ``source, table_schema, constraint_name, tables``.

    One name on several child tables, with a parent extract that does not say which child
    it means. What `foreign_keys` gives for them includes pairs that nobody declared.
    """
    if "constraint_table" in ref_usage.columns:
        ref_usage = ref_usage.where(F.col("constraint_table").isNull())
    children = key_usage.select(*_CONSTRAINT, "table_name").distinct()
    several = children.groupBy(*_CONSTRAINT).agg(F.count(F.lit(1)).alias("tables")).where("tables > 1")
    return lookup_join(several, ref_usage.select(*_CONSTRAINT).distinct(), _CONSTRAINT, "left_semi")


def fks_from_constraint_lists(constraints: DataFrame) -> DataFrame:
    """FKS rows from constraints that list their columns in arrays.

    Layout: ``source, table_name, constraint_index, constraint_type, column_names,
    primary_key_index``. All columns of a key are paired, not only the first.
    """
    child = constraints.filter(F.col("constraint_type") == "FOREIGN KEY").select(
        "source",
        F.col("primary_key_index").alias("key_index"),
        F.col("table_name").alias("child"),
        F.col("column_names").alias("child_columns"),
    )
    parent = constraints.filter(F.col("constraint_type") == "PRIMARY KEY").select(
        "source",
        F.col("constraint_index").alias("key_index"),
        F.col("table_name").alias("parent"),
        F.col("column_names").alias("parent_columns"),
    )
    joined = lookup_join(child, parent, ["source", "key_index"])
    zipped = joined.select(
        "source",
        "child",
        "parent",
        F.explode(F.arrays_zip("child_columns", "parent_columns")).alias("pair"),
    )
    return zipped.select(
        "source",
        *_pairs(
            F.col("child"),
            F.col("pair.child_columns"),
            F.col("parent"),
            F.col("pair.parent_columns"),
        ),
    )


def fks_from_imported_keys(imported: DataFrame) -> DataFrame:
    """FKS rows from an "imported keys" listing."""
    names = ("fk_table_name", "fk_column_name", "pk_table_name", "pk_column_name")
    return imported.select("source", *_pairs(*map(F.col, names)))


def fks_from_pragma(listing: DataFrame) -> DataFrame:
    """FKS rows from a ``foreign_key_list`` listing of many tables.

    Layout: ``source, table_name, id, seq, table, from, to``; rows of tables whose
    listing failed are absent, and a row without a referenced table is skipped.
    """
    return listing.filter(F.col("table").isNotNull()).select(
        "source", *_pairs(*map(F.col, ("table_name", "from", "table", "to")))
    )


@dataclass(frozen=True)
class ForeignKey:
    """A declared relation to verify; several columns form a composite key."""

    source_table: str
    source_columns: tuple[str, ...]
    target_table: str
    target_columns: tuple[str, ...]

    @property
    def name(self) -> str:
        child = f"{self.source_table}({', '.join(self.source_columns)})"
        return f"{child} -> {self.target_table}({', '.join(self.target_columns)})"


def _types(df: DataFrame, columns: tuple[str, ...]) -> list[T.DataType]:
    return [column_type(df, c) for c in columns]


def _side(
    df: DataFrame, columns: tuple[str, ...], others: list[T.DataType]
) -> tuple[str, str]:
    """Key class and expression of the columns, compared with columns of the types ``others``."""
    own = zip(columns, _types(df, columns), others, strict=True)
    typed = [common_key_of(quoted(c), have, other) for c, have, other in own]
    if len(typed) == 1:
        return typed[0]
    # A composite key with a null part refers to nothing, like a null single key.
    complete = " AND ".join(f"{key} IS NOT NULL" for _, key in typed)
    packed = ", ".join(f"'k{i}', {key}" for i, (_, key) in enumerate(typed))
    name = "struct:" + ",".join(c for c, _ in typed)
    return name, f"CASE WHEN {complete} THEN named_struct({packed}) END"


def fk_integrity(tables: dict[str, DataFrame], fks: list[ForeignKey]) -> DataFrame:
    """Child rows, null keys, orphan rows and orphan keys of every foreign key.

    No join: child and parent keys are unpivoted into one long form with a count of
    child rows and a mark for "exists in the parent", then grouped by key. All keys
    of a table share its scans, both sides share one shuffle per key class, and a key
    value that fills a third of the child collapses to one row per map task. Columns of
    unlike types are compared by value, see `lakedoc.functions.keys.common_key_of`.
    """
    children, parents = [], []
    for i, fk in enumerate(fks):
        ends = (tables[fk.source_table], fk.source_columns), (tables[fk.target_table], fk.target_columns)
        types = [_types(*end) for end in ends]
        child, parent = (_side(*end, others) for end, others in zip(ends, reversed(types)))
        children.append(Slot(i, tables[fk.source_table], *child))
        parents.append(Slot(i, tables[fk.target_table], *parent))
    child_long, parent_long = long_values(children), long_values(parents)
    matched = []
    for name in child_long:
        both = child_long[name].select("slot", "value", F.lit(1).alias("n"), F.lit(0).alias("p"))
        both = both.unionByName(
            parent_long[name]
            .filter(F.col("value").isNotNull())
            .select("slot", "value", F.lit(0).alias("n"), F.lit(1).alias("p"))
        )
        matched.append(
            both.groupBy("slot", "value")
            .agg(F.sum("n").alias("n"), F.max("p").alias("p"))
            .select("slot", F.col("value").isNull().alias("is_null"), "n", "p")
        )
    orphan = ~F.col("is_null") & (F.col("p") == 0)
    zero = F.lit(0).cast("long")
    counts = (
        union_all(matched)
        .groupBy("slot")
        .agg(
            F.sum("n").alias("child_rows"),
            F.sum(F.when(F.col("is_null"), F.col("n")).otherwise(zero)).alias("null_keys"),
            F.sum(F.when(orphan, F.col("n")).otherwise(zero)).alias("orphan_rows"),
            F.count(F.when(orphan, 1)).alias("orphan_keys"),
        )
    )
    spark = next(iter(tables.values())).sparkSession
    listed = local_frame(
        spark,
        [
            (i, fk.source_table, ", ".join(fk.source_columns), fk.target_table,
             ", ".join(fk.target_columns))
            for i, fk in enumerate(fks)
        ],
        "slot int, source_table string, source_column string, target_table string,"
        " target_column string",
    )
    measures = ["child_rows", "null_keys", "orphan_rows", "orphan_keys"]
    # One row per foreign key of the argument list.
    return (
        listed.join(F.broadcast(counts), "slot", "left")
        .select(
            "source_table",
            "source_column",
            "target_table",
            "target_column",
            *[F.coalesce(m, zero).alias(m) for m in measures],
        )
        .withColumn("orphan_ratio", null_ratio("orphan_rows", "child_rows"))
    )
