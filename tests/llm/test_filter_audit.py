"""The audit of filters against a plain walk of every document through every order."""

import re
from collections import Counter
from itertools import permutations

from lakedoc.llm.filter_audit import filter_audit

from .conftest import documents

WORDS = [f"w{i}" for i in range(130)]
PROSE = " ".join(WORDS)


def brute_force(docs, labels):
    """``docs``: (doc_id, text, lang); ``labels``: (doc_id, quality, toxic)."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    found = {}
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": i is not None and i > smallest[text],
        }
        for order in permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                counts = found.setdefault((lang or "", "".join(order), step), Counter())
                counts["removed"] += fails[letter] and not gone
                counts["redundant"] += fails[letter] and gone
                counts["unique"] += fails[letter] and sum(fails.values()) == 1
                counts["good"] += fails[letter] and not gone and i in good
                counts["toxic"] += fails[letter] and not gone and i in toxic
                gone = gone or fails[letter]
                counts["kept"] += not gone
    total = Counter()
    for (part, order, step), counts in found.items():
        total[part, order[step - 1]] += counts["removed"]
    names = ("kept", "removed", "redundant", "unique", "good", "toxic")
    return sorted(
        (*key, *(counts[n] for n in names), total[key[0], key[1][key[2] - 1]])
        for key, counts in found.items()
    )


def report(session, docs, labels):
    frame = documents(session, *[(i, t) for i, t, _ in docs])
    rows = session.createDataFrame(docs, "doc_id long, text string, lang string")
    extra = [c for c in frame.columns if c not in rows.columns]
    for name in extra:  # columns whose names clash
        rows = rows.withColumn(name, rows["lang"])
    marks = session.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks = marks.withColumn("n", marks["quality"]).withColumn("part", marks["toxic"])
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
               "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r) for r in filter_audit(rows, marks).select(*columns).collect())


ODD = [
    (1, PROSE, "en"),
    (2, PROSE, "en"),  # E
    (2, PROSE, "en"),  # the same row again: equal ids are not smaller, 1 is
    (3, PROSE, "de"),  # a copy in another part
    (4, None, "en"),
    (5, "", None),
    (6, "short # text", "en"),
    (7, " ".join(["same"] * 200), "en"),
    (8, PROSE.upper() + " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 9, "fr"),
    (9, PROSE + " a|b", ""),
    (None, PROSE, "en"),
    (None, None, None),
    (10, PROSE + " x y" + "\x0b\x1cz", "en"),  # only six characters part words
    (11, "\U0001d400 " * 300 + "Ä" * 90, "en"),
    (12, "word " * 60_000 + "&", "es"),
    (-5, "short # text", "es"),  # smaller than 6
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (6, 1, 1), (7, 0, 1), (None, 1, 1), (99, 1, 1), (9, 2, 3)]


def test_against_brute_force(spark):
    assert report(spark, ODD, LABELS) == brute_force(ODD, LABELS)


def test_all_cells(spark):
    """Texts for all 16 masks of A-D, each twice: 32 cells in one part."""
    docs = []
    for mask in range(16):
        words = WORDS[:50] if mask & 1 else WORDS
        text = " ".join(words[: len(words) // 2] * 2 if mask & 2 else words)
        text += " " + "Q" * (600 if mask & 4 else 0) + ("%" if mask & 8 else "") + f" n{mask}"
        docs += [(100 + mask, text, "en"), (200 + mask, text, "en")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(100, 216)]
    found = report(spark, docs, labels)
    assert found == brute_force(docs, labels) and len(found) == 600


def test_empty(spark):
    assert report(spark, [(1, PROSE, "en")], []) == brute_force([(1, PROSE, "en")], [])
    assert report(spark, ODD[:0], LABELS) == []
