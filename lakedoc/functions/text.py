"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import FENCE, NO_SQL, NOT_AVAILABLE


def is_blank(text: Column) -> Column:
    """A documentation value that counts as missing: null, or only white space.

    Values that are empty in their own type (an empty list or map, false) are null
    already where documentation is parsed or proposed; a text that merely reads
    ``false`` is a text.
    """
    return text.isNull() | (F.trim(text) == "")


def first_filled(*texts: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def python_bool(flag: Column) -> Column:
    return F.when(flag, "True").when(~flag, "False")


def profile_text(ratio: Column, unique: Column, distinct: Column, hint: bool = True) -> Column:
    """Three lines that summarise a profile; a statistic that is null prints N/A.

    ``hint`` adds the reading aid of the database form; the model form omits it.
    """
    shown = [
        F.coalesce(v, F.lit(NOT_AVAILABLE))
        for v in (ratio.cast("string"), python_bool(unique), distinct.cast("string"))
    ]
    return F.concat(
        F.lit("- Null Ratio: "),
        shown[0],
        F.lit(" (0.0 = no nulls)" if hint else ""),
        F.lit("\n- Is Unique: "),
        shown[1],
        F.lit("\n- Distinct Count: "),
        shown[2],
    )


def table_summary(table: Column, names: Column) -> Column:
    """Default summary of a table from its comma-separated column names."""
    return F.concat(
        F.lit("Stores "), table, F.lit(" records with the columns "), names, F.lit(".")
    )


def escape_quotes(text: Column) -> Column:
    """Double single quotes for use inside a SQL string literal."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def strip_fences(text: Column) -> Column:
    """Remove code fences around a chart and trim white space."""
    bare = F.replace(F.replace(text, F.lit(FENCE + "mermaid"), F.lit("")), F.lit(FENCE), F.lit(""))
    return trim_all(bare)


def trim_all(text: Column) -> Column:
    """Trim white space of every script on both sides, control separators included."""
    blank = r"[\s\x1c-\x1f]+"
    return F.regexp_replace(text, rf"(?U)\A{blank}|{blank}\z", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def verdict(answer: Column) -> Column:
    """DRIFT when the answer says so in any case, otherwise MATCH; null without an answer."""
    said = F.when(F.upper(answer).contains("DRIFT"), "DRIFT").otherwise("MATCH")
    return F.when(answer.isNotNull(), said)


def sql_or_note(raw_code: Column, raw_sql: Column) -> Column:
    return first_filled(raw_code, raw_sql, F.lit(NO_SQL))
