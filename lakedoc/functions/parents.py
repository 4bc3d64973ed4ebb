"""Direct parents named in the SQL text of a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r"\s*['\"]([^'\"]+)['\"]\s*"
REF_PATTERN = r"\bref\(" + _QUOTED + r"\)"
SOURCE_PATTERN = r"\bsource\(" + _QUOTED + "," + _QUOTED + r"\)"


def direct_parents(sql: Column) -> Column:
    """Sorted, distinct parents: ``x`` for ref('x'), ``s.t`` for source('s', 't')."""
    refs = F.regexp_extract_all(sql, F.lit(REF_PATTERN), F.lit(1))
    schemas = F.regexp_extract_all(sql, F.lit(SOURCE_PATTERN), F.lit(1))
    tables = F.regexp_extract_all(sql, F.lit(SOURCE_PATTERN), F.lit(2))
    sources = F.zip_with(schemas, tables, lambda s, t: F.concat(s, F.lit("."), t))
    return F.array_sort(F.array_distinct(F.concat(refs, sources)))


def parent_chart(model: Column, parents: Column) -> Column:
    """Flow chart of one model: an arrow from each direct parent.

    The parents come from the text of a single model, so the array is bounded by
    that text and no grouping is needed.
    """
    arrows = F.transform(
        parents,
        lambda p: F.concat(F.lit("    "), p, F.lit(" --> "), model),
    )
    return F.array_join(F.concat(F.array(F.lit("graph TD;")), arrows), "\n")
