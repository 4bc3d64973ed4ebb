"""Lookups with a hot key: how many rows meet in the largest task."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lakedoc.operators.joins import lookup_join

ROWS = 300_000  # two thirds of them have one key

# So small that adaptive execution acts on test data as it does on large tables.
SMALL = {
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "8",
}


@contextmanager
def small_thresholds(session):
    before = {name: session.conf.get(name) for name in SMALL}
    try:
        for name, value in SMALL.items():
            session.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            session.conf.set(name, value)


def largest_task(joined):
    """Rows of the largest task of a join; all columns stay in use, so none is pruned away."""
    tasks = joined.select(
        F.spark_partition_id().alias("task"), F.xxhash64(*joined.columns).alias("row")
    )
    counts = tasks.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("row")).collect()
    assert sum(r.n for r in counts) > 0
    return max(r.n for r in counts)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """``k, v`` with two thirds of the rows at ``k = 0``, stored in eight files."""
    folder = str(tmp_path_factory.mktemp("hot") / "left")
    key = F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 997)
    rows = spark.range(ROWS, numPartitions=8).select(key.alias("k"), F.xxhash64("id").alias("v"))
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("facts") / "right")
    spark.range(5000, numPartitions=4).select((F.col("id") % 600).alias("k"), "id").write.parquet(folder)
    return spark.read.parquet(folder)


def lookups(facts):
    return {
        "distinct": facts.select("k").distinct(),
        "groupBy": facts.groupBy("k").agg(F.max("id").alias("most")),
    }


CASES = [(made_by, how) for made_by in ("distinct", "groupBy") for how in ("inner", "left", "left_semi", "left_anti")]
CASES.remove(("distinct", "left"))  # adds nothing to the left side: Catalyst drops that join


@pytest.mark.parametrize("made_by, how", CASES)
def test_hot_keys_are_split(spark, hot, facts, made_by, how, tmp_path):
    lookup = lookups(facts)[made_by]
    if how == "left_anti":
        lookup = lookup.where("k > 300")  # so that the hot rows are what is left
    with small_thresholds(spark):
        lookup.write.parquet(str(tmp_path / "lookup"))
        stored = spark.read.parquet(str(tmp_path / "lookup"))
        control = largest_task(hot.join(stored.hint("merge"), ["k"], how))
        unsplit = largest_task(hot.join(lookup.hint("merge"), ["k"], how))
        fresh = largest_task(lookup_join(hot, lookup, ["k"], how))
        read = largest_task(lookup_join(hot, stored, ["k"], how, fresh=False))
        hot_rows = ROWS * 2 // 3
        assert control < hot_rows / 2, "the control must split, or this shows nothing"
        assert unsplit >= hot_rows, "without the boundary the hot key is in one task"
        assert fresh < hot_rows / 2 and read < hot_rows / 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_rows_are_those_of_a_plain_join(spark, how):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, 5), (1, 7), (3, 9), (None, 1)], "k int, w int")
    lookup = right.groupBy("k").agg(F.max("w").alias("w"))
    expected = left.join(lookup, ["k"], how)
    found = lookup_join(left, lookup, ["k"], how)
    assert found.columns == expected.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
