"""Codes of vectors against plain integers in plain loops."""

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakedoc.llm.vector_codes import Cells, compress

DDL = "vec_id long, embedding array<float>, label int"


def brute_force(rows, parts=16, entries=64, rounds=2, limit=None):
    """Rows ``(vec_id, vector, label)``; every part is compared with every entry."""
    usable = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not usable:
        return []
    wide = -(-max(max(len(r[1]) for r in usable), 1) // parts) * parts
    size = wide // parts
    cut = []
    for vec_id, vector, label in usable:
        ints = [math.floor(256 * x) for x in vector] + [0] * (wide - len(vector))
        ints = [max(-limit, min(limit, x)) for x in ints] if limit else ints
        cut.append((vec_id, [ints[i * size : (i + 1) * size] for i in range(parts)], label))
    first = sorted(zip(usable, cut), key=lambda p: (p[0][0] is None, p[0][0] or 0, p[0][1]))[:entries]
    books = [[list(c[1][part]) for _, c in first] for part in range(parts)]

    def nearest(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, entry)), i) for i, entry in enumerate(book))

    for _ in range(rounds):
        for part, book in enumerate(books):
            members = [[] for _ in book]
            for _, pieces, _ in cut:
                members[nearest(pieces[part], book)[1]].append(pieces[part])
            for i, some in enumerate(members):
                if some:
                    book[i] = [sum(xs) // len(some) for xs in zip(*some)]
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    sha = hashlib.sha256(numbers.encode()).hexdigest()
    coded = []
    for vec_id, pieces, label in cut:
        found = [nearest(piece, book) for piece, book in zip(pieces, books)]
        coded.append((vec_id, "".join(f"{i:02x}" for _, i in found), sum(e for e, _ in found), label))
    total = {}
    for _, _, error, label in coded:
        total[label] = total.get(label, 0) + error
    return sorted(((v, c, e, total[lab], sha) for v, c, e, lab in coded), key=repr)


def found(session, rows, **options):
    table = session.createDataFrame(rows, DDL)
    for name in ("code", "vector", "error", "label_key", "part"):  # columns whose names clash
        table = table.withColumn(name, table["label"])
    names = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r) for r in compress(table, **options).select(*names).collect()), key=repr)


def floats(rng, n, scale=0.2):
    return [float(np.float32(rng.gauss(0, scale))) for _ in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, floats(rng, 64), rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 2) for i in range(150)]  # copies
    rows += [(2000 + i, [round(x, 1) for x in floats(rng, 64)], 3) for i in range(100)]  # ties
    assert found(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, floats(rng, 32), 1) for i in range(20)]
    rows += [
        (3, floats(rng, 32), None),  # a repeated id
        (None, floats(rng, 32), None),
        (50, None, 1),
        (51, [1.0, None] * 16, 1),
        (52, [float("nan")] * 32, 1),
        (53, [float("-inf")] + [0.0] * 31, 1),
        (54, [], 4),
        (55, floats(rng, 20), 4),  # zeros follow
        (-9, [-0.0] * 32, 4),
        (56, [3e38, -3e38] * 16, 5),
    ]
    assert found(spark, rows) == brute_force(rows, limit=1 << 27)
    few = [r for r in rows if r[0] in (50, 51, 54)]
    assert found(spark, few) == [(54, "00" * 16, 0, 0, hashlib.sha256(b",".join([b"0"] * 16)).hexdigest())]


def test_width_that_parts_do_not_divide(spark):
    rng = random.Random(3)
    rows = [(i, floats(rng, 37), i % 2) for i in range(90)]
    assert found(spark, rows, parts=5, entries=7, rounds=3) == brute_force(rows, 5, 7, 3)


def test_nothing_usable(spark):
    assert found(spark, [(1, None, 1)]) == []
    assert found(spark, [(1, None, 1)][:0]) == []


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=40),
    st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=40),
)
def test_cells_keep_every_nearest_entry(book, points):
    cells = Cells(np.array(book, np.int64), most=3)
    for _ in range(2):  # with cold and warm caches
        index, error = cells.nearest(np.array(points, np.int64))
        apart = ((np.array(points)[:, None] - np.array(book)[None]) ** 2).sum(2)
        assert (index == apart.argmin(1)).all() and (error == apart.min(1)).all()
