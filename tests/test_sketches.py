"""Stored sketches against exact counts, and growth without reading old parts again."""

import shutil

import pytest
from pyspark.sql import functions as F

from lakedoc.operators.profile import profile_table
from lakedoc.operators.sketches import merge_sketches, profile_of_sketches, sketch_parts
from lakedoc.plans.increments import profile_from_path, sketch_to_path, stored_sketches
from tests.conftest import rows


def grown(spark, days):
    frame = spark.range(20_000).select(
        F.concat(F.lit("d"), F.col("id") % 5).alias("day"),
        F.col("id").alias("key"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 700).alias("some"),
        (F.col("id") / 7).alias("number"),
        F.concat(F.lit("text number "), F.col("id") % 3000, F.lit("x" * 80)).alias("text"),
        F.lit(None).cast("int").alias("void"),
    )
    return frame.where(F.col("day").isin(days))


def by_column(profile):
    return {r.column_name: r for r in profile.collect()}


def check(found, frame):
    exact = by_column(profile_table(frame, "t"))
    assert found.keys() == exact.keys()
    for name, row in found.items():
        true = exact[name]
        assert (row.total_count, row.null_count, row.null_ratio) == (
            true.total_count, true.null_count, true.null_ratio)
        assert row.distinct_low <= true.distinct_count <= row.distinct_high, name
        assert row.distinct_low <= row.distinct_count <= row.distinct_high
        assert row.is_unique in (None, true.is_unique)


def test_parts_merge_to_the_profile_of_the_whole(spark):
    frame = grown(spark, [f"d{i}" for i in range(5)])
    sketches = sketch_parts(frame, "t", "day")
    assert sketches.count() == 5 * 6
    found = by_column(profile_of_sketches(merge_sketches(sketches)))
    check(found, frame)
    assert found["void"].distinct_count == 0 and found["void"].median is None
    assert found["text"].median is None and found["some"].is_unique is False
    for column in ("key", "number"):
        low, mid, high = frame.approxQuantile(column, [0.22, 0.5, 0.78], 0.0)
        row = found[column]
        assert low < row.lower_quartile < row.median < row.upper_quartile < high
        assert abs(row.median / mid - 1) < 0.06
    # parts by themselves, and several tables at once
    each = profile_of_sketches(merge_sketches(sketches, ["table_name", "part"]))
    assert {r.total_count for r in each.collect()} == {4000}
    both = sketches.unionByName(sketch_parts(frame, "it's", F.lit("all")))
    assert rows(merge_sketches(both), "table_name", "column_name", "parts")[0] == ("it's", "day", 1)


def test_a_grown_table_reads_only_its_new_part(spark, tmp_path):
    table, store = str(tmp_path / "table"), str(tmp_path / "sketches")
    grown(spark, ["d0", "d1"]).write.partitionBy("day").parquet(table)
    assert sketch_to_path(spark.read.parquet(table), "t", "day", store) == ["d0", "d1"]
    assert sketch_to_path(spark.read.parquet(table), "t", "day", store) == []
    grown(spark, ["d2"]).write.mode("append").partitionBy("day").parquet(table)
    schema = spark.read.parquet(table).schema
    for old in ("d0", "d1"):  # whoever reads these now, fails
        for file in (tmp_path / "table" / f"day={old}").glob("*.parquet"):
            file.write_bytes(b"no longer a file of rows")
            crc = file.with_name(f".{file.name}.crc")
            crc.unlink(missing_ok=True)
    grown_table = spark.read.schema(schema).parquet(table)
    with pytest.raises(Exception):
        grown_table.agg(F.max("key")).collect()
    assert sketch_to_path(grown_table, "t", "day", store) == ["d2"]
    check(by_column(profile_from_path(spark, store)), grown(spark, ["d0", "d1", "d2"]))
    shutil.rmtree(tmp_path / "table")


def test_a_changed_part_is_replaced(spark, tmp_path):
    store = str(tmp_path / "sketches")
    assert stored_sketches(spark, store) is None and profile_from_path(spark, store) is None
    sketch_to_path(grown(spark, ["d0", "d1"]).limit(3000), "t", "day", store)
    again = sketch_to_path(grown(spark, ["d0", "d1"]), "t", "day", store, again=["d0", "d1", "gone"])
    assert again == ["d0", "d1"]
    check(by_column(profile_from_path(spark, store)), grown(spark, ["d0", "d1"]))


def test_odd_parts(spark, tmp_path):
    store = str(tmp_path / "sketches")
    frame = spark.sql(
        "SELECT * FROM VALUES (NULL, 1, double('nan')), ('a\\'b', 1, 2.0D), ('a\\'b', NULL, double('inf')) AS t(p, `x y`, d)"
    )
    assert sketch_to_path(frame, "t", "p", store) == [None, "a'b"]
    assert sketch_to_path(frame, "t", "p", store) == []
    found = by_column(profile_from_path(spark, store))
    check(found, frame)
    assert sketch_to_path(frame.where("p = 'none'"), "t", "p", store) == []
