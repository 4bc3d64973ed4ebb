"""Foreign keys between columns of unlike types: the same matches as Spark's own equality."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from lakedoc.operators.keys import ForeignKey, fk_integrity

# SQL texts of values by type. Texts are such that Spark can compare them with that type.
VALUES = {
    "TINYINT": ["1", "2", "-3", "NULL"],
    "INT": ["1", "2", "-3", "2147483647", "NULL"],
    "BIGINT": ["1", "2", "9007199254740992", "9007199254740993", "-9223372036854775807", "NULL"],
    "FLOAT": ["1", "1.5", "-0.0", "9007199254740992", "float('nan')", "NULL"],
    "DOUBLE": ["1", "1.5", "-3", "0.0", "9007199254740992", "double('nan')", "NULL"],
    "DECIMAL(10,2)": ["1.00", "1.50", "-3.00", "0.00", "NULL"],
    "DECIMAL(20,0)": ["1", "9007199254740992", "9007199254740993", "NULL"],
    "DECIMAL(38,18)": ["1", "1.5", "9007199254740992", "1.000000000000000001", "NULL"],
    "BOOLEAN": ["true", "false", "NULL"],
    "DATE": ["'2024-02-29'", "'1969-12-31'", "NULL"],
    "TIMESTAMP": ["'2024-02-29 00:00:00'", "'2024-02-29 12:30:00.000001'", "NULL"],
    "TIMESTAMP_NTZ": ["'2024-02-29 00:00:00'", "'1969-12-31 00:00:00'", "NULL"],
    "BINARY": ["X'31'", "X''", "NULL"],
}
TEXTS = {
    "numbers": ["'1'", "'01'", "'-3'", "' 2 '", "'+2'", "NULL"],
    "DOUBLE": ["'1'", "'1.50'", "'1e0'", "'-0'", "'9007199254740993'", "NULL"],
    "BOOLEAN": ["'true'", "'t'", "'0'", "NULL"],
    "DATE": ["'2024-02-29'", "'1969-12-31'", "NULL"],
    "BINARY": ["'1'", "''", "'31'", "NULL"],
}
NUMBERS = ("TINYINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "DECIMAL(10,2)", "DECIMAL(20,0)", "DECIMAL(38,18)")
TIMES = ("DATE", "TIMESTAMP", "TIMESTAMP_NTZ")
PAIRS = [
    *product(NUMBERS, NUMBERS),
    *product(TIMES, TIMES),
    ("BOOLEAN", "BOOLEAN"),
    ("BINARY", "BINARY"),
]


def table(session, kind, values):
    rows = " UNION ALL ".join(f"SELECT CAST({v} AS {kind}) AS k" for v in values)
    return session.sql(rows)


def check(child, parent, values):
    """Counts of `fk_integrity` against a join with Spark's ``=``; the child has the values."""
    result = fk_integrity({"c": child, "p": parent}, [ForeignKey("c", ("k",), "p", ("k",))])
    row = result.first()
    keys = parent.select(F.col("k").alias("other")).where("other IS NOT NULL")
    orphans = child.where("k IS NOT NULL").join(keys, F.col("k") == F.col("other"), "left_anti")
    found = (row.child_rows, row.null_keys, row.orphan_rows)
    assert found == (len(values), values.count("NULL"), orphans.count())


@pytest.mark.parametrize("own", sorted({a for a, _ in PAIRS}))
def test_like_sparks_equality(spark, own):
    for other in (b for a, b in PAIRS if a == own):
        check(table(spark, own, VALUES[own]), table(spark, other, VALUES[other]), VALUES[own])


@pytest.mark.parametrize("kind", [k for k in VALUES])
def test_texts_like_sparks_equality(spark, kind):
    whole = kind in ("TINYINT", "INT", "BIGINT")
    numbers = "numbers" if whole else "DOUBLE" if kind in NUMBERS else "DATE" if kind in TIMES else kind
    texts, others = table(spark, "STRING", TEXTS[numbers]), table(spark, kind, VALUES[kind])
    check(texts, others, TEXTS[numbers])
    check(others, texts, VALUES[kind])


def test_texts_that_are_no_numbers_equal_none(spark):
    child = table(spark, "STRING", ["'one'", "'one'", "'1'", "'?1'", "''", "NULL"])
    parent = table(spark, "INT", ["1", "NULL"])
    row = fk_integrity({"c": child, "p": parent}, [ForeignKey("c", ("k",), "p", ("k",))]).first()
    assert (row.child_rows, row.null_keys, row.orphan_rows, row.orphan_keys) == (6, 1, 4, 3)


def test_exact_numbers_are_compared_exactly(spark):
    """Where no decimal holds both, Spark rounds; here no digit is lost."""
    wide = table(spark, "DECIMAL(38,20)", ["9007199254740992", "1.00000000000000000001", "-2.5"])
    for values, orphans in ((["9007199254740993", "1"], 2), (["9007199254740992"], 0)):
        child = table(spark, "BIGINT", values)
        row = fk_integrity({"c": child, "p": wide}, [ForeignKey("c", ("k",), "p", ("k",))]).first()
        assert row.orphan_rows == orphans
    whole = table(spark, "DECIMAL(38,0)", ["-2", "-3", "9007199254740992", "1"])
    row = fk_integrity({"c": wide, "p": whole}, [ForeignKey("c", ("k",), "p", ("k",))]).first()
    assert row.orphan_rows == 2


def test_types_that_spark_does_not_compare_meet_as_texts(spark):
    child = table(spark, "DATE", ["'2024-02-29'"])
    parent = table(spark, "BOOLEAN", ["true"])
    row = fk_integrity({"c": child, "p": parent}, [ForeignKey("c", ("k",), "p", ("k",))]).first()
    assert row.orphan_rows == 1
    both = {"c": spark.sql("SELECT array(1, 2) AS k"), "p": spark.sql("SELECT array(1L, 2L) AS k")}
    assert fk_integrity(both, [ForeignKey("c", ("k",), "p", ("k",))]).first().orphan_rows == 0


def test_composite_keys_of_unlike_types(spark):
    child = spark.sql("SELECT * FROM VALUES ('01', 1.5BD), ('2', 1.0BD), ('x', 1.0BD), (NULL, 1.0BD) AS t(a, b)")
    parent = spark.sql("SELECT * FROM VALUES (1, 1.5D), (2, 9.0D) AS t(a, b)")
    row = fk_integrity({"c": child, "p": parent}, [ForeignKey("c", ("a", "b"), "p", ("a", "b"))]).first()
    assert (row.null_keys, row.orphan_rows) == (1, 2)
