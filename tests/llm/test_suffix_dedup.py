import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lakedoc.llm import suffix_dedup as S
from lakedoc.llm import two_stage
from tests.llm.conftest import documents


def brute(rows, length):
    counts = Counter()
    bodies = [(text or "").encode() for _, text in rows]
    for body in bodies:
        counts.update(body[k : k + length] for k in range(len(body) - length + 1))
    result = []
    for (doc_id, _), body in zip(rows, bodies):
        mark = np.zeros(len(body), bool)
        for k in range(len(body) - length + 1):
            if counts[body[k : k + length]] > 1:
                mark[k : k + length] = True
        kept = bytes(np.frombuffer(body, np.uint8)[~mark])
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        digest = hashlib.sha256(kept).hexdigest()
        result.append((str(doc_id), len(body), int(mark.sum()), spans, digest))
    return sorted(result)


def result(docs, length=200):
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = S.repeat_digests(docs, length).collect()
    return sorted((str(r.doc_id), *(r[c] for c in columns)) for r in found)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(400)]

    def some(k):
        return " ".join(rng.choices(words, k=k))

    passage, rows = some(80), []
    for i in range(n):
        text = some(rng.randint(0, 120))
        kind = rng.randrange(6)
        if kind == 0:
            text += passage + some(30)
        elif kind == 1:
            text += passage[rng.randint(0, 200) :] + passage[: rng.randint(150, 300)]
        elif kind == 2 and rows:
            text = rng.choice(rows)[1]  # a copy
        elif kind == 3 and rows:
            text = rng.choice(rows)[1].replace("a", "b", 3)
        elif kind == 4:
            line = some(45)
            text += f"\n{line}\n{line}"  # within one document
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(900, None), (901, ""), (902, "a" * 1000), (903, "ab" * 300), (904, "a" * 199),
             (905, "é" * 150), (None, rows[5][1]), (906, "\0" * 250)]
    assert result(documents(spark, *rows)) == brute(rows, 200)


def test_short_strings(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("ab \n", k=rng.randint(0, 60)))) for i in range(40)]
    assert result(documents(spark, *rows), 12) == brute(rows, 12)


def test_frequent_anchors_are_counted_string_by_string(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY", 3)
    rows = corpus(11, 80)
    assert result(documents(spark, *rows)) == brute(rows, 200)


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    rows = corpus(12, 12)
    rows = [(1, " ".join(t for _, t in rows)), (2, " ".join(t for _, t in rows[3:])), *rows[4:8]]
    whole = result(documents(spark, *rows))
    assert whole == brute(rows, 200)
    body = rows[0][1].encode()
    expected = [(a, s, n) for a, s, n in zip(*map(list, S.stretches(body)))]
    monkeypatch.setattr(S, "STRETCH", 700)
    anchors = {}
    for anchor, start, count in zip(*S.stretches(body)):
        anchors.update({start + k: anchor for k in range(count)})
    assert anchors == {s + k: a for a, s, n in expected for k in range(n)}


def test_repeated_rows_and_empty_table(spark):
    text = corpus(1)[0][1] + "some more words " * 20
    rows = [(1, text), (1, text), (2, "unique " + "xyz" * 90)]
    assert result(documents(spark, *rows)) == brute(rows, 200)
    assert result(documents(spark, *rows).limit(0)) == []


def test_cut_texts_stay_valid_and_keep_columns(spark):
    rows = corpus(3)
    rows.append((950, "é" + rows[0][1]))
    docs = documents(spark, *rows)
    cut = S.without_repeats(docs)
    assert cut.columns == docs.columns
    expected = {int(i): (n, r) for i, n, r, _, _ in brute(rows, 200)}
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert set(texts) == {i for i, _ in rows}
    for i, text in rows:
        size, removed = expected[i]
        assert size - removed <= len(texts[i].encode()) <= size - removed + 6 * (removed > 0)
        assert removed or texts[i] == text


def test_two_stage_order_against_sorting():
    for seed in range(150):
        rng = random.Random(seed)
        length = rng.choice([7, 8, 10, 20])
        letters = rng.choice([b"ab", b"a", b"abc", bytes(range(256)), b"\0\xff"])
        base = bytes(rng.choices(letters, k=60))
        bodies = [
            base[a : a + rng.randint(length, 30)] if rng.random() < 0.6
            else bytes(rng.choices(letters, k=rng.randint(length, 40)))
            for a in (rng.randint(0, 30) for _ in range(rng.randint(1, 12)))
        ]
        counts = np.array([len(b) - length + 1 for b in bodies])
        seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
        marks = two_stage.repeated_starts(bodies, counts, length)
        for body, mark in zip(bodies, marks):
            assert mark.tolist() == [seen[body[i : i + length]] > 1 for i in range(len(mark))]
