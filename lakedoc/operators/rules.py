"""Documentation rules: predicates over profiles, names and values.

Rules that judge words are heuristics; their patterns are arguments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import quoted
from ..functions.parents import direct_parents
from ..functions.text import is_blank, table_summary
from ..schemas import local_frame
from .columns import column_list
from .longform import column_slot, long_values, value_counts

CATEGORY_BELOW = 10
OPTIONAL_ABOVE = 0.5
MAX_CATEGORIES = 1000

# Words whose presence in a column name suggests personal data.
PII_NAMES = ("email", "name", "phone", "ssn")

# Patterns are searched for, not matched as a whole: one character before the @ is
# enough to find an address, and keeps the search linear in the text.
PII_VALUE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
SAYS_UNIQUE = r"(?i)(unique|identifier|primary key)"
NAMES_CATEGORIES = r"(?i)(one of|either|such as|e\.g\.|category|categories|status is)"


def role(unique: Column, distinct: Column) -> Column:
    return (
        F.when(unique, "identifier")
        .when(distinct < CATEGORY_BELOW, "category")
        .otherwise("attribute")
    )


def column_roles(profile: DataFrame) -> DataFrame:
    """PROFILE plus ``role`` (identifier, category, attribute) and ``is_optional``."""
    return profile.withColumns(
        {
            "role": role(F.col("is_unique"), F.col("distinct_count")),
            "is_optional": F.coalesce(F.col("null_ratio") > OPTIONAL_ABOVE, F.lit(False)),
        }
    )


def describe_columns(profile: DataFrame) -> DataFrame:
    """`column_roles` plus a ``description`` of fewer than 15 words."""
    words = F.replace(F.col("column_name"), F.lit("_"), F.lit(" "))
    table = F.col("table_name")
    text = (
        F.when(
            F.col("role") == "identifier",
            F.concat(F.lit("A unique identifier for each "), table),
        )
        .when(
            F.col("role") == "category",
            F.concat(
                F.lit("The "),
                words,
                F.lit(" category of the "),
                table,
                F.lit(", "),
                F.col("distinct_count").cast("string"),
                F.lit(" values"),
            ),
        )
        .otherwise(F.concat(F.lit("The "), words, F.lit(" of the "), table))
    )
    suffix = F.when(F.col("is_optional"), " (optional).").otherwise(".")
    return column_roles(profile).withColumn("description", F.concat(text, suffix))


def describe_tables(columns: DataFrame) -> DataFrame:
    """``table_name, column_list, summary`` from COLUMNS."""
    return column_list(columns).withColumn(
        "summary", table_summary(F.col("table_name"), F.col("column_list"))
    )


def describe_models(models: DataFrame) -> DataFrame:
    """MODELS plus ``summary``, which names the direct parents found in the SQL."""
    parents = direct_parents(F.col("raw_sql"))
    return models.withColumn(
        "summary",
        F.when(
            F.size(parents) > 0,
            F.concat(
                F.col("name"), F.lit(" is derived from "), F.array_join(parents, ", "), F.lit(".")
            ),
        ).otherwise(F.concat(F.col("name"), F.lit(" has no direct parents."))),
    )


def describe_views(views: DataFrame) -> DataFrame:
    """VIEWS plus ``summary``."""
    models = views.select(
        "*", F.col("view_name").alias("name"), F.col("definition").alias("raw_sql")
    )
    return describe_models(models).drop("name", "raw_sql")


def pii_name(column_name: Column, names: tuple[str, ...] = PII_NAMES) -> Column:
    lowered = F.lower(column_name)
    return reduce(lambda a, b: a | b, [lowered.contains(n.lower()) for n in names])


def pii_by_name(columns: DataFrame, names: tuple[str, ...] = PII_NAMES) -> DataFrame:
    """COLUMNS (or PROFILE) plus ``pii``: whether the name suggests personal data."""
    return columns.withColumn("pii", pii_name(F.col("column_name"), names))


def pii_by_value(
    df: DataFrame,
    columns: list[str],
    table_name: str,
    threshold: float = 0.01,
    patterns: dict[str, str] = PII_VALUE_PATTERNS,
) -> DataFrame:
    """Per text column and pattern, how many values contain it; one scan, whole values."""
    filled = [F.count(quoted(c)).alias(f"f{i}") for i, c in enumerate(columns)]
    hits = [
        F.count(F.when(F.col(quoted(c)).rlike(p), 1)).alias(f"h{i}_{j}")
        for i, c in enumerate(columns)
        for j, p in enumerate(patterns.values())
    ]
    rows = [
        F.struct(
            F.lit(table_name).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.lit(kind).alias("pattern"),
            F.col(f"f{i}").alias("value_count"),
            F.col(f"h{i}_{j}").alias("match_count"),
        )
        for i, c in enumerate(columns)
        for j, kind in enumerate(patterns)
    ]
    share = F.col("match_count") / F.nullif(F.col("value_count"), F.lit(0))
    return (
        df.agg(*filled, *hits)
        .select(F.inline(F.array(*rows)))
        .withColumn("pii", F.coalesce(share >= threshold, F.lit(False)))
    )


def tags_of(
    column_name: Column, rules: list[tuple[str, str]], names: tuple[str, ...] = PII_NAMES
) -> Column:
    """Sorted distinct tags of every rule (pattern, tag) that matches, and ``pii``."""
    found = [F.when(F.lower(column_name).rlike(p), tag) for p, tag in rules]
    found.append(F.when(pii_name(column_name, names), "pii"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def suggest_tags(
    columns: DataFrame, rules: list[tuple[str, str]], names: tuple[str, ...] = PII_NAMES
) -> DataFrame:
    """COLUMNS (or PROFILE) plus ``tags``.

    The rules are an argument, not a table: matching names against patterns would
    otherwise need a join without an equality.
    """
    return columns.withColumn("tags", tags_of(F.col("column_name"), rules, names))


def tests_of(unique: Column, nulls: Column) -> Column:
    return F.array_compact(
        F.array(F.when(unique, "unique"), F.when(nulls == 0, "not_null"))
    )


def suggest_tests(profile: DataFrame) -> DataFrame:
    """PROFILE plus ``tests``: unique, not_null, or an empty list."""
    return profile.withColumn("tests", tests_of(F.col("is_unique"), F.col("null_count")))


def run_tests(
    tables: dict[str, DataFrame], tests: list[tuple[str, str, str]]
) -> DataFrame:
    """Failures of declared tests ``(table, column, unique | not_null)``.

    ``not_null`` counts null rows; ``unique`` counts values that occur more than once
    (nulls ignored). All tests of all tables share the scans of the long form.
    """
    pairs = list(dict.fromkeys((t, c) for t, c, _ in tests))
    slots = [column_slot(i, tables[t], c) for i, (t, c) in enumerate(pairs)]
    counts = (
        value_counts(long_values(slots))
        .groupBy("slot")
        .agg(
            F.sum(F.when(F.col("is_null"), F.col("n")).otherwise(0)).alias("not_null"),
            F.count(F.when(~F.col("is_null") & (F.col("n") > 1), 1)).alias("unique"),
        )
    )
    spark = next(iter(tables.values())).sparkSession
    declared = local_frame(
        spark,
        [(pairs.index((t, c)), t, c, k) for t, c, k in tests],
        "slot int, table_name string, column_name string, test string",
    )
    failures = F.when(F.col("test") == "not_null", F.col("not_null")).otherwise(F.col("unique"))
    # One row per tested column.
    return (
        declared.join(F.broadcast(counts), "slot", "left")
        .select(
            "table_name",
            "column_name",
            "test",
            F.coalesce(failures, F.lit(0).cast("long")).alias("failures"),
        )
        .withColumn("passed", F.col("failures") == 0)
    )


def drift_verdicts(
    docs: DataFrame,
    profile: DataFrame,
    max_categories: int = MAX_CATEGORIES,
    says_unique: str = SAYS_UNIQUE,
    names_categories: str = NAMES_CATEGORIES,
) -> DataFrame:
    """``model_name, column_name, description, verdict`` of described columns.

    DRIFT when the text promises uniqueness that the data lacks, or names categories
    while there are too many values; MATCH otherwise, also if profiling failed.
    """
    described = docs.filter(
        F.col("column_name").isNotNull()
        & (F.col("doc_key") == "description")
        & ~is_blank(F.col("doc_value"))
    ).select("model_name", "column_name", F.col("doc_value").alias("description"))
    facts = profile.select(
        F.col("table_name").alias("model_name"), "column_name", "is_unique", "distinct_count"
    )
    return described.join(facts, ["model_name", "column_name"], "left").select(
        "model_name",
        "column_name",
        "description",
        drift_verdict(
            F.col("description"),
            F.col("is_unique"),
            F.col("distinct_count"),
            max_categories,
            says_unique,
            names_categories,
        ).alias("verdict"),
    )


def drift_verdict(
    text: Column,
    is_unique: Column,
    distinct_count: Column,
    max_categories: int = MAX_CATEGORIES,
    says_unique: str = SAYS_UNIQUE,
    names_categories: str = NAMES_CATEGORIES,
) -> Column:
    """DRIFT or MATCH for one description and the statistics of its column."""
    drift = (text.rlike(says_unique) & ~is_unique) | (
        text.rlike(names_categories) & (distinct_count > max_categories)
    )
    return F.when(drift, "DRIFT").otherwise("MATCH")

