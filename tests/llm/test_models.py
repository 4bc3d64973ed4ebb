import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lakedoc.llm import lm_score, mixing
from lakedoc.llm import quality_model as M
from tests.llm.conftest import documents

LABELS = "doc_id long, quality int, toxic int"


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "##" * (bad and rng.random() < 0.3) for w in rng.choices(words, k=40))))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None), (1001, ""), (None, "a b"), (1002, "x" * 100_000), (5, "again")]
    labels += [(7, 0, 0), (7, 1, 0), (None, 1, 0), (9, None, 1)]
    got = M.classify(documents(spark, *rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels[:600]}
    right = []
    for r in got:
        crc = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1
        assert r.held_out == crc and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert len(right) > 150 and np.mean(right) > 0.95


def test_classifier_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    (row,) = M.classify(documents(spark, (1, "a")), none).collect()
    assert row.score == 0.5
    one = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)
    many = documents(spark, *[(i, "a") for i in range(30)])
    assert min(r.score for r in M.classify(many, one).collect()) > 0.99
    assert M.classify(documents(spark, (1, "a")).limit(0), one).collect() == []


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(80)]
    y = np.where(np.array([1 in x for x in rows]) ^ (rng.random(80) < 0.1), 1.0, -1.0)
    ratio = np.ones(12)
    w, bias = M.descend(rows, y, ratio, epochs=500)
    x = np.zeros((80, 12))
    for i, r in enumerate(rows):
        x[i, r] = 1 / (np.sqrt(len(r)) or 1)

    def primal(w, bias):
        return (w @ w + bias**2) / 2 + np.maximum(0, 1 - y * (x @ w + bias)).sum()

    best = primal(w, bias)
    for _ in range(300):
        assert best <= primal(w + rng.normal(0, 0.02, 12), bias + rng.normal(0, 0.02)) + 1e-6


def texts(n, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choices("etaoins", k=rng.randint(1, 6))) for _ in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]


def test_base_scores_and_counts_against_brute_force(spark):
    rows = texts(150) + [(500, None), (501, "É é A a\x0b\x85b"), (None, "null id"), (4, "again here")]
    docs = documents(spark, *rows)
    got = lm_score.scores(docs, head=64, bits=14, fit_texts=10).collect()
    counts = Counter()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}

    def tokens(text):
        return [*(text or "").encode().lower().split(), b"\n"]

    for i, text in rows:
        if not held[i]:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(i), held[i], len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6))
        for i, t in rows
    )
    assert expected == sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in got
    )
    assert all(r.score < 0 for r in got)
    fresh = [r for r in got if r.held_out]
    assert sum(r.score for r in fresh) > 1.3 * sum(r.base_score for r in fresh)
    assert lm_score.scores(docs.limit(0), bits=14).collect() == []


def small_model():
    sample = [lm_score.tokens_of(t) for _, t in texts(80)]
    counts = Counter(w for s in sample for w in s)
    head = [w for w, _ in counts.most_common(20)]
    rest = {w: c for w, c in counts.items() if w not in head}
    letters = sum((np.bincount(list(w), minlength=256) * c for w, c in rest.items()), np.zeros(256, int))
    code = mixing.Code.build(head, [counts[w] for w in head], sum(rest.values()), 80, letters)
    table = np.zeros((mixing.CONTEXTS, 2 << 12), np.int32)
    mixing.count(mixing.Block(sample, code), code, 12, table)
    return code, mixing.predictors(table)


def test_probabilities_of_all_first_tokens_sum_to_one():
    """Each word of the head, the end, and the escape, as the first token of a text."""
    code, tables = small_model()
    start, total = mixing.initial_weights(), 0.0
    for symbol, words in enumerate([*([w] for w in code.words), [b"zzz"], []]):
        block = mixing.Block([words], code)
        slots, outcome, owner = block.decisions(code, 12)
        assert block.symbols[0] == symbol
        cost = code.rest[symbol]
        for d in np.flatnonzero(owner == 0):
            packed = [int(tables[c][slots[c][d]]) for c in range(mixing.CONTEXTS)]
            gate = (packed[1] & 3) << 2 | packed[2] & 3
            z = sum((p >> 2) / 512 * w for p, w in zip(packed, start[gate]))
            cost += math.log1p(math.exp(-z if outcome[d] else z))
        total += math.exp(-cost)
    assert abs(total - 1) < 1e-6


def test_codes_are_complete_and_the_rest_follows_the_counts():
    counts = np.array([50, 1, 1, 0, 7, 3, 2, 900, 4, 4, 1, 1, 0, 0, 5, 6])
    lengths = mixing.code_lengths(counts)
    assert abs((2.0**-lengths).sum() - 1) < 1e-12
    sizes, nodes, bits, rest = mixing.code_paths(counts, 1, 3)
    assert sizes.max() == 3 and len(nodes) == len(bits) == sizes.sum()
    ends = np.cumsum(sizes)
    paths = [tuple(bits[e - n : e]) for e, n in zip(ends, sizes)]
    for path in set(paths):  # the symbols below one node share its probability
        assert abs(sum(math.exp(-rest[i]) for i in range(16) if paths[i] == path) - 1) < 1e-9


def test_costs_do_not_depend_on_the_block():
    code, tables = small_model()
    start = mixing.initial_weights()
    own = [lm_score.tokens_of(t) for _, t in texts(30, 5)] + [[b"x" * 4000], []]
    own.append([w for words in own for w in words] * 5)
    together = mixing.cost(mixing.Block(own, code), code, tables, 12, start)
    alone = [mixing.cost(mixing.Block([t], code), code, tables, 12, start)[0] for t in own]
    assert np.allclose(together, alone, rtol=1e-5)


def test_every_decision_of_a_word_is_predicted_in_context():
    words = [b"w%d" % i for i in range(5000)]
    code = mixing.Code.build(words, [1] * 5000, 1, 1, np.ones(256, int))
    assert np.abs(code.rest).max() < 1e-12 and code.sizes[:5000].min() >= 12
    # a rare word that always follows another one costs little, though its code is long
    pairs = [[words[4000], words[4001]]] * 50
    table = np.zeros((mixing.CONTEXTS, 2 << 16), np.int32)
    mixing.count(mixing.Block(pairs, code), code, 16, table)
    tables, start = mixing.predictors(table), mixing.initial_weights()
    seen, other = (
        mixing.cost(mixing.Block([[words[4000], w]], code), code, tables, 16, start)[0]
        for w in (words[4001], words[4002])
    )
    assert seen < other - 3


def test_short_texts_adapt_in_short_steps():
    code, tables = small_model()
    start = mixing.initial_weights()
    words = [w for _, t in texts(40, 9) for w in lm_score.tokens_of(t)][:25]
    block = mixing.Block([words], code)
    assert mixing.STEP < len(block.decisions(code, 12)[1]) < 512
    moved, still = (mixing.cost(block, code, tables, 12, start, rate=r)[0] for r in (0.03, 0.0))
    assert abs(moved - still) > 1e-4


def test_refinement_lowers_the_cost_of_what_it_was_fitted_on():
    code, tables = small_model()
    weights = 0.3 * mixing.initial_weights()  # far too timid
    block = mixing.Block([lm_score.tokens_of(t) for _, t in texts(60, 11)], code)
    refine = mixing.fit_refinement(block, code, tables, 12, weights)
    plain, refined = (
        mixing.cost(block, code, tables, 12, weights, 0.0, r).sum() for r in (None, refine)
    )
    assert refined < 0.99 * plain


def test_bits_of_texts(spark):
    rows = texts(60) + [(700, "é b"), (701, "")]
    for r in lm_score.scores(documents(spark, *rows), head=64, bits=14, fit_texts=10).collect():
        n = len(dict(rows)[r.doc_id].encode())
        assert math.isclose(r.total_bits, -r.score / math.log10(2))
        assert r.bits_per_byte is None if n == 0 else math.isclose(r.bits_per_byte, r.total_bits / n)


def test_a_repeated_id_does_not_fill_the_sample(spark, monkeypatch):
    rows = [(i, f"good words {i}" if i % 2 else f"bad ## {i}") for i in range(200)]
    rows += [(7, f"other good words {i}") for i in range(150)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], LABELS)
    sizes = []
    plain = M.descend
    monkeypatch.setattr(M, "descend", lambda found, *a, **b: sizes.append(len(found)) or plain(found, *a, **b))
    for fit_rows in (20, 60, 120):
        M.classify(documents(spark, *rows), labels, fit_rows=fit_rows).collect()
    assert sizes == [15, 45, 90]  # a quarter is kept out


def test_weights_are_fitted_on_all_training_texts(spark, monkeypatch):
    """Every training text is in the tables and is read once for the weights."""
    rows = texts(120) + [(7, "one id many texts"), (7, "one id many texts more"), (None, "no id")]
    met = {}
    fit = mixing.fit
    monkeypatch.setattr(mixing, "fit", lambda told, n, *a: met.update(n=n.sum()) or fit(told, n, *a))
    model, _ = lm_score.train(documents(spark, *rows), head=64, bits=14)
    training = [lm_score.tokens_of(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    block = mixing.Block(training, model.code)
    assert met["n"] == len(block.decisions(model.code, 14)[1])
    table = np.zeros((mixing.CONTEXTS, 2 << 14), np.int32)
    mixing.count(block, model.code, 14, table)
    assert (mixing.predictors(table) == model.tables).all()


def test_fitted_weights_code_better_than_timid_ones():
    code, tables = small_model()
    block = mixing.Block([lm_score.tokens_of(t) for _, t in texts(60, 11)], code)
    told, timid = np.zeros(mixing.TOLD, np.int64), 0.3 * mixing.initial_weights()
    mixing.tell(block, code, mixing.opinions(tables), 12, told)
    cells = np.flatnonzero(told)
    weights, refine = mixing.fit(cells, told[cells], timid)
    plain, fitted, refined = (
        mixing.cost(block, code, tables, 12, w, 0.0, r).sum()
        for w, r in ((timid, None), (weights, None), (weights, refine))
    )
    assert fitted < 0.95 * plain and refined < fitted


def test_decisions_of_four_levels_lie_side_by_side():
    code, _ = small_model()
    block = mixing.Block([lm_score.tokens_of(t) for _, t in texts(20, 7)], code)
    slots, _, owner = block.decisions(code, 12)
    depth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    assert depth.max() >= mixing.TREE
    for slot in slots:
        root = slot[np.arange(len(owner)) - depth % mixing.TREE]
        assert ((slot - root) % (1 << 12) < 15).all()
        assert len(set(root % 16)) > 8  # the roots, which are met most, lie anywhere


def test_no_slot_depends_on_the_outcome():
    code, _ = small_model()
    first = mixing.Block([[word] for word in code.words] + [[]], code)
    slots, outcome, owner = first.decisions(code, 12)
    begins = np.searchsorted(owner, np.flatnonzero(np.append(True, first.text[1:] != first.text[:-1])))
    assert set(outcome[begins]) == {0, 1}
    assert all(len(set(slot[begins])) == 1 for slot in slots)


def test_distinct_words_and_trigrams_count_and_tell_as_all_texts_do(monkeypatch):
    """Windows of a few tokens, portions of a few counts: tables and cells stay the same."""
    code, tables = small_model()
    rows = [t for _, t in texts(60, 8)] + ["again and again\x0b\x85 X x"] * 7 + ["", "y" * 300]
    halves = np.arange(len(rows), dtype=np.int32) % 2
    batch = pa.RecordBatch.from_arrays([pa.array(halves), pa.array(rows)], names=["half", "text"])
    monkeypatch.setattr(lm_score, "_KEPT", 40)
    monkeypatch.setattr(lm_score, "_MOST", 50)
    monkeypatch.setattr(mixing, "_TOGETHER", 64)
    said = mixing.opinions(tables)
    plain, table = np.zeros((2, 2, mixing.CONTEXTS, 2 << 12), np.int32)
    cells, told = np.zeros((2, mixing.TOLD), np.int64)
    for half in range(2):
        own = [lm_score.tokens_of(t) for t, h in zip(rows, halves) if h == half]
        mixing.count(block := mixing.Block(own, code), code, 12, plain[half])
        mixing.tell(block, code, said, 12, cells)
        slots, outcome, _ = block.decisions(code, 12)
        for row, slot in zip(plain[half], slots):  # `count` itself against one addition each
            np.subtract.at(row, 2 * slot + outcome, 1)
    assert not plain.any()
    for half in range(2):
        own = [lm_score.tokens_of(t) for t, h in zip(rows, halves) if h == half]
        mixing.count(mixing.Block(own, code), code, 12, plain[half])
    counted = pa.Table.from_batches(lm_score._count_words([batch])).to_pandas()
    n = counted.groupby("word").sum()
    expected = Counter(w for t in rows for w in [*lm_score.tokens_of(t), mixing.END_WORD])
    assert dict(n["n"]) == expected
    words = pa.RecordBatch.from_pandas(n.reset_index(), preserve_index=False)
    for half, met in lm_score._trigrams([batch], code):
        mixing.count_trigrams(*met, code, 12, table[half])
        mixing.tell_trigrams(*mixing.distinct(*met, code), code, said, 12, told)
    portions = list(lm_score._words([words]))
    assert len(portions) > 5 and max(times.sum() for _, times in portions) <= 50
    for word, times in portions:
        for half in range(2):
            mixing.count_words(word, times[half], code, 12, table[half])
            mixing.tell_words(word, times[half], code, said, 12, told)
    assert (plain == table).all() and (cells == told).all()
