import random

import numpy as np
import xxhash

from lakedoc.llm import simhash as S
from tests.llm.conftest import documents


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """Smallest member by brute force, for ``{id: fingerprint}``."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_fingerprints_and_groups_of_texts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcé", k=4)) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(80)]
    base = rng.choices(words, k=3000)
    for i in range(100, 112):  # a few words changed in a long text
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(3000)] = "other"
        rows.append((i, "\n ".join(copy).upper()))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "two words")]
    got = {r.doc_id: r for r in S.near_groups(documents(spark, *rows)).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    groups = brute_groups(prints)
    assert {i: r.component_id for i, r in got.items()} == groups
    kept = S.near_dedup(documents(spark, *rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))


def test_no_link_is_lost_and_components_are_right(spark):
    rng = random.Random(9)
    prints = []
    for _ in range(40):  # chains of small steps, and values around one centre
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.append(value)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                value ^= 1 << bit
    centre = rng.getrandbits(64)
    for _ in range(300):
        value = centre
        for bit in rng.sample(range(12), rng.randint(0, 4)):
            value ^= 1 << bit
        prints.append(value)
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = S.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in found)
    assert len(found) < 131 * len(prints)
    from lakedoc.llm.components import components

    roots = {r.node: r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    expected = brute_groups(dict(zip(signed, prints)))
    mine = {p: roots.get(p, p) for p in signed}
    assert mine == expected


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "q")]
    got = S.near_groups(documents(spark, *rows)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [
        ("5", 5), ("5", 5), ("9", 9), ("None", 5)
    ]
    assert sorted(r.doc_id for r in S.near_dedup(documents(spark, *rows)).collect()) == [5, 9]
    assert S.near_groups(documents(spark, *rows).limit(0)).collect() == []
