"""Grouping keys: many columns of unlike types brought to a few comparable classes.

Counting distinct values column by column costs one scan per column. Columns of one
class can instead be unpivoted and grouped together, so a table needs one scan per
*class* (usually three or four) however wide it is. Every mapping is injective: two
values share a key exactly when they are equal.

Keys are SQL expression texts: a catalog of thousands of columns is then handed to
Spark in few calls.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Strings of at least this many bytes are replaced by their SHA-256 digest (64 hex
# digits). Shorter strings stay as they are and can never equal a digest, which is
# exactly this long. It bounds the shuffled row by the digest, not by the text.
DIGEST_BYTES = 64

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def quoted(name: str) -> str:
    """A column name as an SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def is_groupable(data_type: T.DataType) -> bool:
    """Whether values of the type can be compared for equality by Spark."""
    if isinstance(data_type, T.ArrayType):
        return is_groupable(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return is_groupable(data_type.keyType) and is_groupable(data_type.valueType)
    if isinstance(data_type, T.StructType):
        return all(is_groupable(f.dataType) for f in data_type.fields)
    simple = data_type.simpleString()
    return not simple.startswith(("variant", "geometry", "geography", "void"))


def key_of(value: str, data_type: T.DataType) -> tuple[str, str]:
    """``(class name, key)`` of an SQL value; equal class names can share one unpivot."""
    if isinstance(data_type, _INTEGRAL):
        return "long", f"CAST({value} AS BIGINT)"
    if isinstance(data_type, T.BooleanType):
        return "long", f"CAST(CAST({value} AS INT) AS BIGINT)"
    if isinstance(data_type, T.DateType):
        return "long", f"CAST(unix_date({value}) AS BIGINT)"
    if isinstance(data_type, T.TimestampType):
        return "long", f"unix_micros({value})"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        # Grouping itself makes all NaN equal and 0.0 equal to -0.0.
        return "double", f"CAST({value} AS DOUBLE)"
    if isinstance(data_type, T.DecimalType):
        return "string", f"CAST({value} AS STRING)"
    if data_type == T.StringType():
        short = f"octet_length({value}) < {DIGEST_BYTES}"
        return "string", f"CASE WHEN {short} THEN {value} ELSE sha2({value}, 256) END"
    if isinstance(data_type, T.BinaryType):
        short = f"octet_length({value}) < {DIGEST_BYTES // 2}"
        return "string", f"CASE WHEN {short} THEN hex({value}) ELSE sha2({value}, 256) END"
    if isinstance(data_type, T.MapType):
        return f"entries:{data_type.simpleString()}", f"array_sort(map_entries({value}))"
    # Collated strings, zone-less timestamps, intervals, arrays and structs keep
    # their own type and so their own class.
    return data_type.simpleString(), value


# Decimal digits of whole numbers, and types of time that widen into each other.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
_TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)
_INEXACT = (T.FloatType, T.DoubleType)


def common_key_of(value: str, own: T.DataType, other: T.DataType) -> tuple[str, str]:
    """`key_of` for values of ``own`` that are compared with values of ``other``.

    Called once for each side; the class names agree, and two values share a key exactly
    when they are equal:

    * whole numbers and decimals by their exact value (Spark's equality does so as well,
      but rounds where both together need more than 38 digits);
    * either of them and a float or double as doubles; dates and times in the wider type;
    * a text and another scalar in the other's type, as Spark's equality does: whole
      numbers as ``bigint``, all other numbers as doubles. A text that does not read as
      such a value equals none, and is a key of its own;
    * other unlike types, which Spark does not compare, as texts.
    """
    if own == other:
        return key_of(value, own)
    kinds = (own, other)
    if any(isinstance(kind, T.StringType) for kind in kinds):
        plain = other if isinstance(own, T.StringType) else own
        return _text_or(value, own, plain)
    if all(isinstance(kind, T.NumericType) for kind in kinds):
        if any(isinstance(kind, _INEXACT) for kind in kinds):
            return key_of(f"CAST({value} AS DOUBLE)", T.DoubleType())
        if all(isinstance(kind, _INTEGRAL) for kind in kinds):
            return key_of(value, own)
        return _exact_number(value, kinds)
    if all(isinstance(kind, _TIMES) for kind in kinds):
        wide = _TIMES[max(_TIMES.index(type(kind)) for kind in kinds)]()
        return key_of(f"CAST({value} AS {wide.simpleString()})", wide)
    return key_of(value if isinstance(own, T.StringType) else f"CAST({value} AS STRING)", T.StringType())


def _text_or(value: str, own: T.DataType, plain: T.DataType) -> tuple[str, str]:
    """Key of a side of a comparison between a text and a ``plain`` type."""
    if isinstance(plain, T.StringType):  # another collation
        return key_of(f"CAST({value} AS STRING)", T.StringType())
    if isinstance(plain, T.BinaryType):
        return key_of(f"CAST({value} AS BINARY)", plain)
    if isinstance(plain, T.NumericType):
        plain = T.LongType() if isinstance(plain, _INTEGRAL) else T.DoubleType()
    elif not isinstance(plain, (T.BooleanType, *_TIMES)):
        return key_of(f"CAST({value} AS STRING)", T.StringType())
    typed = text_key_of(f"TRY_CAST({value} AS {plain.simpleString()})", plain)[1]
    if isinstance(own, T.StringType):
        kept = key_of(value, own)[1]  # no typed key begins with a question mark
        typed = f"CASE WHEN {value} IS NOT NULL THEN coalesce({typed}, concat('?', {kept})) END"
    return "string", typed


def _exact_number(value: str, kinds: tuple[T.DataType, ...]) -> tuple[str, str]:
    """Key of a whole number or decimal among numbers of several such types."""
    whole = max(k.precision - k.scale if isinstance(k, T.DecimalType) else _DIGITS[type(k)] for k in kinds)
    scale = max(getattr(k, "scale", 0) for k in kinds)
    if whole + scale <= 38:
        wide = T.DecimalType(whole + scale, scale)
        return key_of(f"CAST({value} AS {wide.simpleString()})", wide)
    # No decimal holds both: the whole below it, and what is left, each exactly.
    below = f"CAST(CAST(floor({value}) AS DECIMAL(38,0)) AS STRING)"
    rest = f"CAST(CAST({value} % 1 AS DECIMAL(38,38)) AS STRING)"
    return "string", f"concat({below}, '|', {rest})"


def text_key_of(value: str, data_type: T.DataType) -> tuple[str, str]:
    """Like `key_of` with every scalar as text, so that one scan serves all columns.

    For inputs that cannot be read column by column (CSV, JSON, JDBC).
    """
    name, key = key_of(value, data_type)
    if name == "double":
        return "string", f"CAST({key} + 0.0D AS STRING)"  # -0.0 + 0.0 is 0.0
    if name in ("long", "timestamp_ntz"):
        return "string", f"CAST({key} AS STRING)"
    return name, key
