import math
import random

from lakedoc.llm import quality_rules as Q
from tests.llm.conftest import documents


def windows(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside.update(range(i, i + 3))
    return len(inside)


def brute(text):
    words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, windows(words)


def test_base_features_against_brute_force(spark):
    rng = random.Random(5)
    pieces = ["a", "b", "é", "#", " ", "  ", "\n", "\t", "日", "\x85", "\xa0", "|x", "\x1c", "\r\n"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 80)))) for i in range(150)]
    rows += [(900, None), (901, "w " * 40_000), (902, " \n ")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.judged(documents(spark, *rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        names = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines)
        if r.doc_id != 901:
            assert (*names, r.n_repeat_words) == brute(text), text
        else:
            assert (r.n_words, r.n_repeat_words) == (40_000, 40_000)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_binomial_bound_is_exact():
    def tail(k, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for n in (1, 10, 97, 400):
        for risk in (0.01, 0.05, 0.3):
            for level in (0.001, 0.05):
                k = Q.most_failures(n, risk, level)
                assert k < 0 or tail(k, n, risk) <= level
                assert tail(k + 1, n, risk) > level or k == n
    assert Q.most_failures(0, 0.1, 0.1) == -1


def test_cutoffs_respect_the_risk_and_catch_junk(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]

    def text(mark):
        return " ".join(w + mark for w in rng.sample(words, 60))

    rows = [(i, text("#$" if i % 10 == 0 else "")) for i in range(1500)]
    labels = [(i, int(i % 10 != 0), 0) for i in range(1500)]
    # contradictory and null labels are left out
    labels += [(1, 0, 0), (None, 1, 0), (2, None, 0)]
    ddl = "doc_id long, quality int, toxic int"
    got = Q.judged(documents(spark, *rows), spark.createDataFrame(labels, ddl)).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {i for i in range(1500) if i % 10}
    docs = documents(spark, *rows)
    filtered = Q.keep_good(docs, spark.createDataFrame(labels, ddl))
    assert {r.doc_id for r in filtered.collect()} == kept and filtered.columns == docs.columns


def test_a_rule_that_catches_nothing_rejects_nothing():
    good, bad = {"r": [0] * Q.BINS}, {"r": [0] * Q.BINS}
    good["r"][0], good["r"][300], bad["r"][0] = 1000, 3, 50
    assert Q.design(good, bad) == [{"r": Q.BINS}]
    # a step that loses more than it catches is certified, but not taken
    assert Q.certified([0, 3, 997], [0, 3, 997], [0, 5, 45], 0.05, 0.01) == 0
    assert Q.certified([0, 3, 997], [0, 3, 997], [0, 61, 45], 0.05, 0.01) == 1


def test_paths_are_nested_and_follow_the_best_ratio():
    rng = random.Random(11)
    for _ in range(20):
        good, bad = (
            {r: [rng.choice((0, 0, 0, 1, 4)) for _ in range(Q.BINS)] for r in "abc"} for _ in range(2)
        )
        path = Q.design(good, bad)
        assert path[0] == dict.fromkeys("abc", Q.BINS)
        for before, after in zip(path, path[1:]):
            changed = [r for r in "abc" if before[r] != after[r]]
            assert len(changed) == 1 and 1 <= after[changed[0]] < before[changed[0]]

    good, bad = ({r: [0] * Q.BINS for r in "ab"} for _ in range(2))
    bad["a"][390], good["a"][380], bad["a"][370] = 5, 9, 50
    bad["b"][399] = 7
    # b first; then a down to 370 at once, as 55 / 10 beats 5 / 1; gaps below are halved
    assert [(p["a"], p["b"]) for p in Q.design(good, bad)] == [(400, 400), (400, 200), (186, 200)]


def test_joint_cutoffs_against_brute_force(spark):
    """Every vector of the path is applied to every text; the bound is of the union of rules."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]

    def text(bad):
        some = rng.sample(words, 60)
        for i in range(60):
            if rng.random() < (0.5 if bad else 0.02):
                some[i] = some[i] + "#$" if rng.random() < 0.5 else some[i].upper()
        lines = [" ".join(some[i : i + 10]) for i in range(0, 60, 10)]
        return "\n".join(lines + lines[:1] * rng.choice((0, 0, 2 if bad else 0)))

    rows = [(i, text(i % 4 == 0), "aa" if i % 3 else "bb") for i in range(900)]
    quality = {i: int(i % 4 != 0) if rng.random() < 0.98 else int(i % 4 == 0) for i in range(800)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int")
    tests = {r[0] for r in docs.where("pmod(xxhash64(doc_id), 2) = 1").select("doc_id").collect()}

    def bins(body):
        n_words, chars, symbols, dup, repeat, lines, upper, marks = Q.features_of(body)
        values = (symbols / n_words / 2, marks / n_words / 2, upper / chars, dup / lines, repeat / n_words)
        return {r: 0 if v <= 0 else min(1 + int(min(v, 1) * (Q.BINS - 1)), Q.BINS - 1) for r, v in zip(Q.RULES, values)}

    expected = set()
    for lang in ("aa", "bb"):
        mine = {i: bins(body) for i, body, of in rows if of == lang}
        count = lambda q: {
            r: [sum(quality.get(i) == q and i not in tests and b[r] == at for i, b in mine.items()) for at in range(Q.BINS)]
            for r in Q.RULES
        }
        path = Q.design(count(1), count(0))
        assert len(path) > 3
        gone = [{i for i, b in mine.items() if any(b[r] >= cuts[r] for r in Q.RULES)} for cuts in path]
        n = sum(quality.get(i) == 1 and i in tests for i in mine)
        tail = lambda k: sum(math.comb(n, j) * 0.05**j * 0.95 ** (n - j) for j in range(k + 1))
        best, gain = 0, 0
        for step, some in enumerate(gone):
            lost = sum(quality.get(i) == 1 and i in tests for i in some)
            if step and tail(lost) > 0.1 / 2:
                break
            caught = sum(quality.get(i) == 0 for i in some)
            value = caught - Q.GOOD_WEIGHT * sum(quality.get(i) == 1 for i in some)
            if value > gain:
                best, gain = step, value
        assert best > 0
        expected |= mine.keys() - gone[best]
    assert {r.doc_id for r in Q.judged(docs, labels).collect() if r.kept} == expected
    assert {r.doc_id for r in Q.keep_good(docs, labels).collect()} == expected


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.judged(documents(spark, (1, "a")).limit(0), labels).collect() == []
    (row,) = Q.judged(documents(spark, (None, " ".join(map(str, range(60))))), labels).collect()
    assert row.kept and row.doc_id is None


def test_every_stratum_is_judged_by_its_own_labels(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]

    def text(mark):
        return " ".join(w + mark for w in rng.sample(words, 60))

    # good texts of the small stratum look like bad ones of the large; another has no labels
    rows = [(i, text("#$" if i % 10 == 0 else "")) for i in range(3000)]
    rows += [(i, text("#$")) for i in range(3000, 3140)]
    labels = [(i, int(i % 10 != 0 or i >= 3000), 0) for i in range(3010)]
    docs = documents(spark, *rows).selectExpr(
        "* except (lang)",
        "case when doc_id < 3000 then 'en' when doc_id < 3100 then 'xx' else 'yy' end as lang",
    )
    held = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    expected = {i for i, _ in rows if i >= 3000 or i % 10}
    assert {r.doc_id for r in Q.judged(docs, held).collect() if r.kept} == expected
    assert {r.doc_id for r in Q.keep_good(docs, held).collect()} == expected
    # any number of strata
    many = docs.selectExpr("* except (lang)", "if(doc_id < 2000, 'en', cast(doc_id as string)) as lang")
    kept = {r.doc_id for r in Q.judged(many, held).collect() if r.kept}
    assert kept >= set(range(2000, 3140))
