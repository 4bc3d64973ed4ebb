"""Nearest vectors against a comparison with every row."""

import math
import random

import numpy as np
import pytest

from lakedoc.llm.hamming_search import Codes, MultiIndex, nearest

DDL = "vec_id long, embedding array<float>, label int"


def cosine(a, b):
    wide = max(len(a), len(b))
    a, b = (list(v) + [0.0] * (wide - len(v)) for v in (a, b))
    dot = one = two = 0.0
    for x, y in zip(a, b):
        dot, one, two = dot + x * y, one + x * x, two + y * y
    return dot / (math.sqrt(one) * math.sqrt(two))


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector) and any(vector)


def brute_force(rows, k=5, every=50):
    rows = [r for r in rows if usable(r[1])]
    out = []
    for at, (query, vector, _) in enumerate(rows):
        if query is None or query % every:
            continue
        others = [(-cosine(v, vector), i is None, i or 0, i) for n, (i, v, _) in enumerate(rows) if n != at]
        best = sorted(others, key=lambda o: o[:3])[:k]
        out += [(query, rank, i, -minus) for rank, (minus, _, _, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def found(session, rows, **options):
    table = session.createDataFrame(rows, DDL)
    for name in ("vector", "a", "b", "ids", "shard", "block", "rank", "found", "n"):  # names that clash
        table = table.withColumn(name, table["label"])
    columns = ("query_id", "rank", "vec_id", "score")
    return sorted((tuple(r) for r in nearest(table, **options).select(*columns).collect()), key=repr)


def rounded(rows):
    return sorted(((q, r, i, round(s, 12)) for q, r, i, s in rows), key=repr)


def floats(rng, n=16):
    return [float(np.float32(rng.gauss(0, 1))) for _ in range(n)]


def test_against_brute_force(spark):
    """With all queries in the calibration and recall 1, nothing is missed."""
    rng = random.Random(4)
    rows = [(i, floats(rng), 0) for i in range(700)]
    rows += [(1000 + i, rows[50][1], 1) for i in range(120)]  # copies, queries among them
    rows += [(2000 + i, [float(rng.choice((-1, 0, 1))) for _ in range(16)], 2) for i in range(200)]  # ties
    expected = brute_force(rows)
    assert rounded(found(spark, rows, recall=1.0)) == rounded(expected)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, floats(rng, 8), None) for i in range(30)]
    rows += [
        (0, floats(rng, 8), 1),  # a repeated id is a query of its own
        (50, rows[0][1], 1),
        (50, rows[0][1], 1),  # a repeated row: each finds the other
        (None, rows[0][1], 1),
        (None, rows[0][1], 1),
        (100, None, 1),
        (150, [0.0, -0.0] * 4, 1),
        (200, [1.0, None] * 4, 1),
        (250, [float("nan")] * 8, 1),
        (300, [float("inf")] + [0.0] * 7, 1),
        (350, [], 1),
        (400, floats(rng, 5), 1),  # zeros follow
        (450, [1e-44] * 8, 1),
        (500, [3e38, -3e38] * 4, 1),
        (-50, floats(rng, 8), 1),
    ]
    assert rounded(found(spark, rows, recall=1.0)) == rounded(brute_force(rows))


def test_few_rows(spark):
    rng = random.Random(6)
    rows = [(50 * i, floats(rng), 0) for i in range(3)]
    assert rounded(found(spark, rows)) == rounded(brute_force(rows))
    assert found(spark, rows[:1]) == [] and found(spark, [(1, None, 0)]) == []
    assert found(spark, rows[:0]) == []
    with_others = [(i, v, 0) for i, v, _ in rows] + [(7, floats(rng), 0)]
    assert rounded(found(spark, with_others, k=2, query_every=7)) == rounded(brute_force(with_others, 2, 7))


def test_recall(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 48))
    points = centres[rng.integers(0, 12, 4000)] + 0.7 * rng.standard_normal((4000, 48))
    rows = [(i, [float(x) for x in np.float32(p)], 0) for i, p in enumerate(points)]
    got = found(spark, rows, query_every=10)
    normed = points / np.linalg.norm(points, axis=1, keepdims=True)
    hits = 0
    for query in range(0, 4000, 10):
        near = normed @ normed[query]
        near[query] = -9
        hits += len(set(np.argsort(-near)[:5]) & {i for q, _, i, _ in got if q == query})
    assert len(got) == 2000 and hits / 2000 >= 0.95


@pytest.mark.parametrize("rows", [3, 300, 9000])
def test_pigeonhole_finds_all_within(rows):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((rows, 20))
    codes = Codes.learn(vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).of(vectors)
    asked = codes[: min(rows, 40)] ^ (np.uint16(1) << rng.integers(0, 16, (min(rows, 40), codes.shape[1])).astype(np.uint16))
    index = MultiIndex(codes)
    apart = np.bitwise_count(asked[:, None] ^ codes[None]).sum(2)
    for radius in (0, 1, 2, 3, 7, 13, 22, 30, 47, 64, 99):
        query, row = index.within(asked, radius)
        assert sorted(zip(query.tolist(), row.tolist())) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(apart <= radius))))
        assert (index.apart(asked, query, row) == apart[query, row]).all()
