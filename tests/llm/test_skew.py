"""Hot keys of the corpus operators: the largest task, beside a control that does split.

Each operator's join is taken where it is made, so the test sees the plan as it is run.
"""

import pytest
from pyspark.sql import functions as F

from lakedoc.llm import components as C
from lakedoc.llm import simhash as S
from lakedoc.llm import suffix_dedup as D
from lakedoc.operators import joins
from tests.test_joins import largest_task, small_thresholds

N = 60_000


@pytest.fixture
def measured(spark, monkeypatch, tmp_path):
    """Sizes of the largest tasks of all lookups that are made: as they are, and of a control."""
    sizes = []

    def measuring(left, lookup, keys, how="inner", **options):
        joined = joins.lookup_join(left, lookup, keys, how, **options)
        folder = str(tmp_path / f"lookup{len(sizes)}")
        lookup.write.parquet(folder)
        control = left.join(spark.read.parquet(folder).hint("merge"), keys, how)
        hottest = left.groupBy(*keys).count().agg(F.max("count")).first()[0]
        plain = left.join(lookup.hint("merge"), keys, how)
        sizes.append((hottest, *map(largest_task, (joined, control, plain))))
        return joined

    for module in (C, S, D):
        monkeypatch.setattr(module, "lookup_join", measuring)
    with small_thresholds(spark):
        yield sizes


def split(sizes):
    """Lookups with a hot key, all of which must be split where the control is."""
    hot = [s for s in sizes if s[0] > N / 3]
    assert hot, "there is no hot key, so this shows nothing"
    for hottest, size, control, _ in hot:
        assert control < hottest * 0.6, "the control must split, or this shows nothing"
        assert size < hottest * 0.6, sizes
    return hot


def test_star_centre(spark, measured, tmp_path):
    """A node that is linked with all others."""
    spark.range(1, N, 1, 8).selectExpr("id * 7919 AS a", "0L AS b").write.parquet(str(tmp_path / "links"))
    found = C.components(spark.read.parquet(str(tmp_path / "links")))
    assert found.count() == N - 1 and found.agg(F.max("root")).first()[0] == 0
    split(measured)


def test_root_of_most_fingerprints(spark, measured, monkeypatch, tmp_path):
    """One component that holds nearly all fingerprints."""
    prints = spark.range(1, N, 1, 8).selectExpr("xxhash64(id) AS fp", "id AS doc_id")
    chain = prints.selectExpr("fp AS node", f"{-(1 << 63)}L AS root")
    monkeypatch.setattr(S, "fingerprints", lambda *a: prints)
    monkeypatch.setattr(S, "links", lambda distinct: distinct)
    monkeypatch.setattr(S, "components", lambda links: chain)
    groups = S.near_groups(prints.withColumn("text", F.lit("")))
    assert groups.agg(F.count("*"), F.max("component_id")).first() == (N - 1, 1)
    split(measured)


def test_anchor_of_most_texts(spark, measured, monkeypatch):
    """An anchor that stands in every text."""
    def listed(length):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                k1 = batch.column(1)
                zero = pa.array([7] * len(k1), pa.int64())
                yield pa.RecordBatch.from_arrays([zero, k1, k1], names=["anchor", "k1", "k2"])

        return run

    def counted(length):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                k1 = batch.column(1)
                zero = pa.array([7] * len(k1), pa.int64())
                yield pa.RecordBatch.from_arrays([zero, k1, k1], names=["anchor", "low", "high"])

        return run

    monkeypatch.setattr(D, "_list_anchors", listed)
    monkeypatch.setattr(D, "_count_anchors", counted)
    monkeypatch.setattr(D, "_extract", lambda length: lambda batches: iter(()))
    docs = spark.range(0, N, 1, 8).selectExpr("id AS doc_id", "concat(repeat('x', 210), id) AS text")
    D.repeats(docs)
    split(measured)
