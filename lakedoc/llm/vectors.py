"""What the operators on vectors share: clean rows and their components as an array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True if the vector is not null and no component is null, infinite or not a number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def clean(table: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """``vec_id, vector`` and the other columns, of the rows with a usable vector."""
    single = table.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = table[vector_col] if single else table[vector_col].cast("array<double>")
    return table.select(
        table[id_col].cast("long").alias("vec_id"),
        vector.alias("vector"),
        *(table[name].alias(name) for name in others),
    ).where(finite(F.col("vector")))


def width(rows: DataFrame) -> int:
    """The largest number of components; shorter vectors count as if zeros followed."""
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    """Rows of ``wide`` doubles from a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == wide).all():
        return values.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide))
    out[np.arange(wide) < lengths[:, None]] = values
    return out
