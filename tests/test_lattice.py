"""Composite keys against counting every column set."""

import os
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lakedoc.operators import lattice
from lakedoc.operators.lattice import composite_keys
from tests.conftest import rows


def brute_force(data, names, most):
    keys = []
    for size in range(1, most + 1):
        for some in combinations(range(len(names)), size):
            values = [tuple(row[i] for i in some) for row in data]
            full = values and all(v is not None for row in values for v in row)
            if full and len(set(values)) == len(values) and not any(set(k) < set(some) for k in keys):
                keys.append(some)
    return sorted(", ".join(names[i] for i in key) for key in keys)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e", "f"]
    sizes = [rng.choice((2, 5, 12, 30, 60)) for _ in names]
    data = [tuple(rng.randrange(n) for n in sizes) for _ in range(60)]
    if seed == 1:
        data = [(*row[:2], None if i == 5 else row[2], *row[3:]) for i, row in enumerate(data)]
    if seed == 2:
        data += data[:1]  # a repeated row: no keys at all
    frame = spark.createDataFrame(data, ", ".join(f"{n} int" for n in names))
    for most in (2, 3, 4):
        found = [r[0] for r in rows(composite_keys(frame, "t", most), "column_names")]
        assert found == brute_force(data, names, most)


def test_types_and_limits(spark):
    frame = spark.sql(
        "SELECT id DIV 10 AS `x y`, CAST(id % 10 AS STRING) AS s, array(id) AS list, parse_json('1') AS v,"
        " CAST(id % 2 AS DOUBLE) AS d FROM range(100)"
    )
    assert rows(composite_keys(frame, "t")) == [("t", "list", 1), ("t", "x y, s", 2)]
    assert rows(composite_keys(frame, "t", 1)) == [("t", "list", 1)]
    assert rows(composite_keys(frame, "t", columns=["s", "d", "x y"])) == [("t", "x y, s", 2)]
    assert rows(composite_keys(frame.limit(0), "t")) == []


def test_sets_in_several_scans(spark):
    frame = spark.range(300).selectExpr("id DIV 20 AS a", "id % 20 AS b", "id % 3 AS c", "id % 7 AS d")
    expected = rows(composite_keys(frame, "t"))
    assert ("t", "a, b", 2) in expected and rows(composite_keys(frame, "t", sets_per_scan=2)) == expected


def test_small_parts_do_not_hide_a_key(spark):
    """A pair whose product is below the rows still counts as part of a key of three."""
    frame = spark.range(1000).selectExpr("id % 10 AS a", "id DIV 10 % 10 AS b", "id DIV 100 AS c")
    assert rows(composite_keys(frame, "t"), "column_names") == [("a, b, c",)]


def test_sets_that_nearly_are_keys_are_not_counted_over_all_rows(spark, monkeypatch):
    """A few rows in a hundred agree: too few for a sketch to tell, enough for one bucket."""
    counted, exact = [], lattice._exact
    monkeypatch.setattr(lattice, "_exact", lambda df, sets, n: counted.extend(sets) or exact(df, sets, n))
    frame = spark.range(20_800).selectExpr(
        "id AS k", "id % 20000 % 200 AS a", "id % 20000 DIV 200 AS b", "id % 20000 % 3 AS c"
    )
    assert rows(composite_keys(frame, "t"), "column_names") == [("k",)]
    assert counted == [("k",)]
    # a single pair of rows may lie in another bucket: then the count decides
    assert rows(composite_keys(frame.where("id <= 20000").drop("k"), "t")) == []
    for buckets in (1, 7):
        kept = frame.where("id < 20000")
        assert rows(composite_keys(kept, "t", buckets=buckets), "column_names") == [("a, b",), ("k",)]


def as_if_large(monkeypatch, **limits):
    """Lets tables of a few rows take the way of large ones."""
    for name, value in ({"LEAST_ROWS": 4, "MOST_ROWS": 8, "HASHED_ROWS": 16} | limits).items():
        monkeypatch.setattr(lattice, name, value)


# hashes as they are, so short that unlike rows share them, and with more repeats than are kept
@pytest.mark.parametrize("bits, kept", [(32, 2**18), (7, 2**18), (5, 4)])
def test_hashes_against_brute_force(spark, monkeypatch, bits, kept):
    as_if_large(monkeypatch, REPEATS=kept, COMPARED=kept // 2)
    monkeypatch.setattr(lattice, "_bits", lambda n_rows: bits)
    rng = random.Random(bits)
    names = ["a", "b", "c", "d", "e"]
    data = [tuple(rng.randrange(n) for n in (40, 30, 12, 5, 3)) for _ in range(60)]
    data += [(0, 99, i, 9, 9) for i in range(30)]  # a hot value of two columns
    frame = spark.createDataFrame(data, ", ".join(f"{n} int" for n in names)).repartition(3)
    assert [r[0] for r in rows(composite_keys(frame, "t"), "column_names")] == brute_force(data, names, 3)


def test_hashes_of_values_that_are_equal_in_other_bytes(spark, monkeypatch):
    as_if_large(monkeypatch)
    frame = spark.sql(
        "SELECT id AS k, CASE id WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D ELSE id END AS zero,"
        " CASE id WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN sqrt(-1D) ELSE id END AS nan,"
        " array(CASE id WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D ELSE id END) AS list,"
        " CAST(CASE id WHEN 0 THEN 'a' WHEN 1 THEN 'A' ELSE CAST(id AS STRING) END AS STRING COLLATE UTF8_LCASE) AS lcase,"
        " CAST(CASE id WHEN 0 THEN 'a' WHEN 1 THEN 'A' ELSE CAST(id AS STRING) END AS STRING) AS exact FROM range(40)"
    )
    assert rows(composite_keys(frame, "t", 1), "column_names") == [("exact",), ("k",)]
    assert lattice._exact(frame, [(c,) for c in frame.columns], 40) == {("exact",), ("k",)}
    assert rows(composite_keys(frame.drop("k", "exact"), "t", 2), "column_names") == []
    rest = frame.drop("exact").withColumn("k", F.col("k") % 7)
    found = rows(composite_keys(rest, "t", 2), "column_names")
    assert found == [("k, lcase",), ("k, list",), ("k, nan",), ("k, zero",)]


def test_packed_hashes_are_those_of_the_rows(spark, monkeypatch):
    as_if_large(monkeypatch)
    frame = spark.range(200).selectExpr("id % 190 AS a", "id DIV 2 AS b").repartition(2)
    repeats = lattice._hash_repeats(frame, [("a",), ("b",), ("a", "b")], 200)
    codes = frame.selectExpr(f"{lattice._code(frame, 'a')} AS a", f"{lattice._code(frame, 'b')} AS b").collect()
    for some, of in ((("a",), lambda r: r.a), (("b",), lambda r: r.b), (("a", "b"), lambda r: r.a ^ r.b)):
        hashes = [(of(r) % 2**64) >> (64 - lattice._bits(200)) for r in codes]
        again = {h for h in hashes if hashes.count(h) > 1}
        assert set(repeats[some][0].tolist()) == again and repeats[some][1]
    assert len(repeats[("a",)][0]) == 10 and len(repeats[("b",)][0]) == 100


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = manager.localDirsString()
    found = {}
    for top in folders:
        for folder, _, names in os.walk(top):
            found |= {f"{folder}/{n}": os.path.getsize(f"{folder}/{n}") for n in names if n.endswith(".data")}
    return found


def test_sets_of_a_large_table_take_a_few_bytes_a_row(spark):
    """Six sets of three share a pair with few repeats: it is hashed for all of them."""
    n = 300_000
    assert n > lattice.MOST_ROWS
    drawn = [f"pmod(xxhash64(id, {i}), {n}) AS {c}" for i, (c, n) in enumerate(
        [("a", 60_000), ("b", 60_000), *[(c, 30 + i) for i, c in enumerate("cdefgh")]])]
    frame = spark.range(0, n, 1, 4).selectExpr(*drawn)
    before = shuffle_files(spark)
    found = rows(composite_keys(frame, "t"), "column_names")
    after = shuffle_files(spark)
    assert sum(size for name, size in after.items() if name not in before) < 20 * n
    sets = [("a", "b"), *[("a", "b", c) for c in "cdefgh"]]
    counted = lattice._counted(frame, sets, n)
    assert ("a", "b") not in counted and found == sorted((", ".join(some),) for some in counted)
    body = lattice._packed(frame, sets[:1], n).agg(F.sum(F.octet_length("body"))).first()[0]
    assert body < 4 * n


def test_bucket_of_a_hot_value_is_not_taken(spark, monkeypatch):
    as_if_large(monkeypatch)
    frame = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN -1 ELSE id END AS hot", "id % 3 AS few")
    taken = lattice._buckets_taken(frame, ["hot", "few"], 4000, 64)
    hot = frame.where(f"pmod({lattice._code(frame, 'hot')}, 64) = {taken['hot']}").count()
    assert 0 < hot < 100 and "few" not in taken


def test_rows_that_repeat_on_a_subset_are_many(spark, monkeypatch):
    """A hot pair of values: its rows are hashed once more, and only they."""
    as_if_large(monkeypatch, HASHED_ROWS=256)
    frame = spark.range(3000).selectExpr(
        "CASE WHEN id < 1000 THEN 1 ELSE id END AS a", "CASE WHEN id < 1000 THEN 1 ELSE id % 9 END AS b",
        "id % 1000 AS c", "id % 500 AS d", "id % 300 AS `a h`",
    )
    hashed, run = [], lattice._hash_repeats
    monkeypatch.setattr(lattice, "_hash_repeats", lambda df, sets, n: hashed.append((sets, n)) or run(df, sets, n))
    sets = [("a", "b", "c"), ("a", "b", "d"), ("a", "b", "a h")]
    assert lattice._refined(frame, {("a", "b"): sets}, 3000) == {("a", "b", "c")}
    assert hashed == [([("a", "b")], 3000), (sets, 1000)]
