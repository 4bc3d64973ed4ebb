"""Names that many projects can have in common, and what tells them apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_of(manifest_path: Column) -> Column:
    """The project of a manifest: its root folder, or the path if it does not lie in ``target``."""
    return F.regexp_replace(manifest_path, r"/target/[^/]*\.json$", "")


def qualified_id(*parts: Column | str) -> Column:
    """A surrogate id of 32 hex digits; equal for equal parts only, whatever they contain."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    named = F.struct(*[c.alias(f"p{i}") for i, c in enumerate(columns)])
    return F.substring(F.sha2(F.to_json(named), 256), 1, 32)
