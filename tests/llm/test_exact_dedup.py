import hashlib
import random

from lakedoc.llm.exact_dedup import _merge, exact_dedup, exact_groups
from lakedoc.llm.trie import OwnerTrie
from tests.llm.conftest import documents


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    best = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return groups, best


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["", None, "A", "a", "É", "é", "x" * 30_000, "x" * 30_000 + "y", "İ", "line\n", "\0"]
    rows = [(i, rng.choice(texts)) for i in range(200)]
    got = exact_groups(documents(spark, *rows)).collect()
    groups, best = brute(rows)
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in rows:
        body = (text or "").encode().lower()
        r = by_id[i]
        assert (r.keep_id, r.group_size) == (best[body], len(groups[body]))
        assert r.kept == (i == best[body])
        assert r.text_sha256 == hashlib.sha256(body).hexdigest()
    kept = exact_dedup(documents(spark, *rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best.values())
    assert kept.columns == documents(spark, *rows).columns


def test_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "A"), (7, "b"), (7, "B"), (7, "b"), (3, "b"), (None, "c"), (1, "c")]
    got = exact_groups(documents(spark, *rows)).collect()
    assert len(got) == 8
    assert sorted((str(r.keep_id), r.group_size) for r in got if r.kept) == [
        ("1", 2), ("7", 4), ("None", 2)
    ]
    assert exact_dedup(documents(spark, *rows)).count() == 3


def test_empty_table(spark):
    empty = documents(spark, (1, "a")).limit(0)
    assert exact_groups(empty).collect() == [] and exact_dedup(empty).collect() == []


def test_trie_with_and_without_spilling():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    keys += [b"shared prefix " * 20 + k for k in keys]
    expected = {}
    for i, k in enumerate(keys):
        expected[k] = _merge(expected[k], (i, 1, 1)) if k in expected else (i, 1, 1)
    for limit in (1 << 30, 40_000, 2_000):
        trie = OwnerTrie(_merge, limit)
        for i, k in enumerate(keys):
            trie.insert(k, (i, 1, 1))
        items = list(trie.items())
        assert len(items) == len(expected) and dict(items) == expected
