"""Discovery of foreign keys against a comparison of all columns' values."""

import random

from pyspark.sql import functions as F

from lakedoc.operators.inclusion import fk_candidates, included, signatures
from tests.conftest import rows


def brute_force(columns):
    """``{(table, column): (domain, values)}`` to the rows of `fk_candidates`."""
    found = []
    for child, (domain, values) in columns.items():
        some = {v for v in values if v is not None}
        for parent, (other, keys) in columns.items():
            unique = keys and None not in keys and len(set(keys)) == len(keys)
            if child != parent and domain == other and unique and some and some <= set(keys):
                found.append((*child, *parent, len(some), len(keys), len(some) / len(keys)))
    return sorted(found, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(1)
    n = 400
    a = {
        "id": ("number", list(range(n))),
        "ref": ("number", [rng.choice([None, *range(50, 90)]) for _ in range(n)]),
        "wide": ("number", [float(rng.randrange(n)) for _ in range(n)]),
        "broken": ("number", [rng.randrange(n) + 0.5 * (i == 7) for i in range(n)]),
        "name": ("text", [f"n{i}" for i in range(n)]),
        "tag": ("text", [rng.choice(["n1", "n20", "n399"]) for _ in range(n)]),
        "other": ("text", [rng.choice(["n1", "n20", "x"]) for _ in range(n)]),
        "void": ("text", [None] * n),
    }
    b = {
        "key": ("number", [*map(float, range(0, 2 * n, 2)), 1.5]),
        "text": ("text", [f"n{i}" for i in range(n + 1)]),
    }
    left = spark.createDataFrame(
        list(zip(*(v for _, v in a.values()))),
        "id long, ref int, wide double, broken double, name string, tag string, other string, void string",
    )
    right = spark.createDataFrame(list(zip(*(v for _, v in b.values()))), "key double, text string")
    right = right.withColumn("key", F.col("key").cast("decimal(12,2)"))
    columns = {("a", c): v for c, v in a.items()} | {("b", c): v for c, v in b.items()}
    tables = {"a": left, "b": right}
    names = ("source_table", "source_column", "target_table", "target_column",
             "source_distinct", "target_distinct", "coverage")
    expected = brute_force(columns)
    assert len(expected) >= 4
    for size in (1, 4, 256):  # signatures only rule out
        assert rows(fk_candidates(tables, size), *names) == expected
    tables["empty"] = left.limit(0)
    assert rows(fk_candidates(tables), *names) == expected


def test_many_columns_need_several_words(spark):
    frame = spark.range(200).select(
        "id", *[(F.col("id") % (i + 2)).cast("int").alias(f"c{i}") for i in range(150)]
    )
    found = rows(fk_candidates({"t": frame}), "source_column", "target_column", "source_distinct")
    assert found == sorted(((f"c{i}", "id", min(i + 2, 200)) for i in range(150)), key=repr)


def test_times_and_large_numbers(spark):
    days = spark.sql("SELECT DATE'2024-01-01' + CAST(id AS INT) AS day, id + 9007199254740992 AS big FROM range(9)")
    times = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, id) AS at,"
        " CAST(2 * id + 9007199254740992 AS DECIMAL(20,0)) AS even FROM range(9)"
    )
    found = rows(fk_candidates({"d": days, "t": times}), "source_column", "target_column")
    assert found == [("at", "day"), ("day", "at")]
    # as doubles big and even would be equal here; as exact numbers they are not
    pairs = [(("d", "big"), ("t", "even"))]
    assert rows(included({"d": days.limit(2), "t": times}, pairs)) == []


def test_signatures_hold_the_smallest_hashes(spark):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 1000).alias("v"))
    row = signatures({"t": frame}, 10).first()
    hashes = [r[0] for r in frame.where("v IS NOT NULL").select(F.expr("xxhash64(CAST(v AS DOUBLE) + 0.0D)")).distinct().collect()]
    assert (row.rows, row.nulls, row.distincts) == (3000, 1000, len(hashes))
    assert row.hashes == sorted(hashes)[:10]


def test_no_tables_with_comparable_columns(spark):
    frame = spark.sql("SELECT parse_json('1') AS v")
    assert rows(fk_candidates({"t": frame})) == []


def test_signatures_group_all_values_once(spark, tmp_path, capsys):
    """Counts and smallest hashes share one scan of a table, and so do children and parents."""
    spark.range(500).selectExpr("id", "IF(id % 3 = 0, NULL, id % 7) AS part").write.parquet(str(tmp_path / "t"))
    found = signatures({"t": spark.read.parquet(str(tmp_path / "t"))}, 5)
    got = {r.column_name: r for r in found.collect()}
    found.explain()
    final = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert "Final Plan" in final and final.count("FileScan parquet") == 1
    assert (got["part"].rows, got["part"].nulls, got["part"].distincts) == (500, 167, 7)
    assert [len(got[c].hashes) for c in ("id", "part")] == [5, 5]
    assert None not in got["part"].hashes and got["part"].hashes == sorted(got["part"].hashes)
