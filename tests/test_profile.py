import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakedoc.functions.ratios import null_ratio
from lakedoc.operators import profile as P
from lakedoc.plans.catalog import profile_to_path
from tests.conftest import rows

FACTS = ("column_name", "null_ratio", "distinct_count", "is_unique")


@pytest.fixture(scope="module")
def small(spark):
    data = [
        (11, "oak", None, 2.5),
        (12, "elm", True, 2.5),
        (13, "ash", None, -1.0),
        (14, "fir", None, 2.5),
        (15, "yew", False, 0.25),
        (16, "bay", False, 0.25),
        (17, "box", None, -1.0),
        (18, "may", True, 2.5),
    ]
    return spark.createDataFrame(data, "id int, tree string, tall boolean, weight double")


EXPECTED = [
    ("id", 0.0, 8, True),
    ("tall", 0.5, 2, False),
    ("tree", 0.0, 8, True),
    ("weight", 0.0, 3, False),
]


@pytest.mark.parametrize("options", [{}, {"one_scan": True}, {"columns_per_scan": 1}])
def test_small_table(small, options):
    assert rows(P.profile_table(small, "t", **options), *FACTS) == EXPECTED


def test_single_column_equals_table(small):
    for expected in EXPECTED:
        assert rows(P.profile_column(small, expected[0], "t"), *FACTS) == [expected]


def test_ratio_is_rounded_like_the_division(spark):
    frame = spark.range(0, 201).select(F.col("id").alias("n"), F.lit(200).cast("long").alias("t"))
    got = dict(frame.select("n", null_ratio("n", "t")).collect())
    assert got == {n: round(n / 200, 2) for n in range(201)}


def test_ratio_against_python_on_many_pairs(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(3000):
        total = rng.choice([8, 40, 200, 1000, 16, 999, 7, 10**9])
        pairs.append((rng.randint(0, total), total))
    frame = spark.createDataFrame(pairs, "n long, t long")
    for n, t, ratio in frame.select("n", "t", null_ratio("n", "t")).collect():
        assert ratio == round(n / t, 2), (n, t)


def test_arithmetic(spark):
    frame = spark.range(100).select(
        F.when(F.col("id") >= 10, F.col("id")).alias("ten_nulls"),
        F.col("id").alias("full"),
        F.when(F.col("id") >= 1, F.col("id")).alias("one_null"),
    )
    assert rows(P.profile_table(frame, "t"), *FACTS) == [
        ("full", 0.0, 100, True),
        ("one_null", 0.01, 99, False),
        ("ten_nulls", 0.1, 90, False),
    ]


@pytest.mark.parametrize("options", [{}, {"approx": 0.05}, {"one_scan": True}])
def test_empty_table(small, options):
    profile = P.profile_table(small.filter("id < 0"), "t", **options)
    got = rows(profile, "null_ratio", "distinct_count", "is_unique", "profile_status")
    assert got == [(0.0, 0, True, "empty")] * 4
    assert P.candidate_keys(profile).count() == 0


def test_failing_columns_do_not_stop_the_others(spark):
    frame = spark.range(4).select("id", F.parse_json(F.lit('{"a": 1}')).alias("v"))
    profile = P.profile_table(frame, "t", ["id", "v", "gone"], extended=True)
    got = rows(profile, "column_name", "distinct_count", "is_unique", "profile_status")
    assert got == [
        ("gone", None, None, "failed"),
        ("id", 4, True, "ok"),
        ("v", None, None, "failed"),
    ]
    assert rows(P.profile_table(frame, "t", ["gone"]), "profile_status") == [("failed",)]


def test_every_type(spark):
    long_text = "x" * 5000
    frame = spark.sql(
        f"""
        SELECT * FROM VALUES
          (true, 1Y, 2S, 1.5F, 1.50BD, DATE'2020-01-01', TIMESTAMP'2020-01-01 00:00:00',
           TIMESTAMP_NTZ'2020-03-08 02:30:00', X'00', '{long_text}a', array(1, 2), map('a', 1, 'b', 2),
           named_struct('x', 1), INTERVAL '1' DAY, 0.0D),
          (false, 2Y, 2S, 1.5F, 1.5BD, DATE'2020-01-02', TIMESTAMP'2020-01-01 00:00:00.000001',
           TIMESTAMP_NTZ'2020-03-08 03:30:00', X'0000', '{long_text}b', array(2, 1), map('b', 2, 'a', 1),
           named_struct('x', 1), INTERVAL '2' DAY, -0.0D),
          (NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        AS t(bool, tiny, small, flt, dec, day, ts, ntz, bin, txt, arr, mp, st, iv, zero)
        """
    )
    expected = {
        "bool": 2, "tiny": 2, "small": 1, "flt": 1, "dec": 1, "day": 2, "ts": 2, "ntz": 2,
        "bin": 2, "txt": 2, "arr": 2, "mp": 1, "st": 1, "iv": 2, "zero": 1,
    }
    for options in ({}, {"one_scan": True}):
        profile = P.profile_table(frame, "t", **options)
        got = {r.column_name: (r.distinct_count, r.null_count) for r in profile.collect()}
        assert got == {k: (v, 1) for k, v in expected.items()}


def test_time_zone_does_not_merge_zoneless_times(spark):
    frame = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ'2020-03-08 02:30:00'),"
        " (TIMESTAMP_NTZ'2020-03-08 03:30:00') t(x)"
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for options in ({}, {"one_scan": True}):
            profile = P.profile_table(frame, "t", **options)
            assert rows(profile, "distinct_count") == [(2,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_digests_do_not_collide_with_short_strings(spark):
    # A short string can never look like the digest of a long one.
    frame = spark.range(1).select(F.lit("y" * 64).alias("a")).union(
        spark.range(1).select(F.sha2(F.lit("y" * 64), 256))
    )
    assert rows(P.profile_table(frame, "t"), "distinct_count") == [(2,)]


def test_odd_column_names(spark):
    frame = spark.range(3).toDF("a.b `c`")
    assert rows(P.profile_table(frame, "t"), "column_name", "distinct_count") == [("a.b `c`", 3)]


def test_extended(spark):
    frame = spark.createDataFrame([(1, "b", [1]), (3, "a", [2]), (None, None, None)], "n int, s string, a array<int>")
    profile = P.profile_table(frame, "t", extended=True)
    assert rows(profile, "column_name", "min_value", "max_value", "avg_value") == [
        ("a", None, None, None),
        ("n", "1", "3", 2.0),
        ("s", "a", "b", None),
    ]


def test_approximate_bounds_and_exact_uniqueness(spark):
    frame = spark.range(20000).select(
        "id",
        F.when(F.col("id") == 0, 1).otherwise(F.col("id")).alias("nearly"),
        (F.col("id") % 1000).alias("thousand"),
        F.when(F.col("id") > 9, F.col("id")).alias("gaps"),
    )
    profile = {r.column_name: r for r in P.profile_table(frame, "t", approx=0.05).collect()}
    assert profile["id"].is_unique and profile["id"].distinct_count == 20000
    assert not profile["nearly"].is_unique and profile["nearly"].distinct_count == 19999
    assert abs(profile["thousand"].distinct_count - 1000) < 150
    assert profile["gaps"].null_count == 10 and not profile["gaps"].is_unique


def test_hot_value(spark):
    frame = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    assert rows(P.profile_table(frame, "t"), "total_count", "distinct_count") == [(30000, 20001)]


def test_composite_key_with_nulls(spark):
    frame = spark.createDataFrame([(1, 1), (1, 2), (None, 1)], "a int, b int")
    got = rows(P.is_composite_key(frame, ["a", "b"]), "total_count", "null_count", "distinct_count", "is_key")
    assert got == [(3, 1, 2, False)]
    kept = frame.filter("a IS NOT NULL")
    assert rows(P.is_composite_key(kept, ["a", "b"]), "is_key") == [(True,)]
    assert rows(P.is_composite_key(kept, ["a"]), "is_key") == [(False,)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(-3, 3)),
            st.one_of(st.none(), st.text("ab", max_size=2)),
            st.one_of(st.none(), st.floats(allow_nan=True, width=32)),
        ),
        min_size=1,
        max_size=30,
    )
)
def test_invariants(spark, data):
    frame = spark.createDataFrame(data, "i int, s string, d float")
    for r in P.profile_table(frame, "t").collect():
        assert 0 <= r.null_ratio <= 1 and r.distinct_count + r.null_count <= r.total_count
        values = {v for v in (row["isd".index(r.column_name)] for row in data) if v is not None}
        if r.column_name != "d":
            assert r.distinct_count == len(values)
            assert r.is_unique == (len(values) == len(data))


def test_profile_in_batches_resumes(spark, small, tmp_path):
    tables = {f"t{i}": small for i in range(5)}
    path = str(tmp_path / "profile")
    assert profile_to_path({"t0": small}, path) == ["t0"]
    assert profile_to_path(tables, path, tables_per_job=2) == ["t1", "t2", "t3", "t4"]
    saved = spark.read.parquet(path)
    assert saved.count() == 20 and saved.select("table_name").distinct().count() == 5
    # other columns or options are another profile
    assert profile_to_path({"t0": small.drop("tree")}, path) == ["t0"]
    assert profile_to_path({"t1": small}, path, approx=0.05) == ["t1"]
    assert profile_to_path(tables, path) == []
