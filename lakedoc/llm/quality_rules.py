"""Operator 10: quality rules whose cutoffs carry a risk guarantee.

Method: each rule is a feature of a text and a cutoff above which the text is rejected; a
text goes if any rule rejects it. The cutoffs of all rules are certified *together*, per
stratum, from labelled texts in two halves (by hash of the id). One half designs a path: a
sequence of cutoff vectors from "nothing is rejected" on, each at least as strict as the
one before, the steps that catch most bad texts for each good one first (`design`). The
other half tests the vectors in that order: one passes while the exact (Clopper-Pearson)
upper bound of the share of good texts that its rules reject, any of them, stays below the
risk, and the first failure ends the sequence. As the order does not depend on the texts
that are tested, it needs no correction (fixed-sequence testing); only the error level is
divided by the strata (Bonferroni). Of the certified vectors the one is taken that catches
most bad texts; among equals the mildest, and each good text lost counts as `GOOD_WEIGHT`
bad ones, so that rules which catch nothing reject nothing. With confidence ``1 - delta``
no stratum loses more than ``risk`` of its good texts to the learned rules.

Every stratum is tested against its own labelled good texts, few or many: the bound decides
by itself. Where they are too few to certify anything, or there are none, the learned rules
reject nothing.

Plan: one pass computes the features of all whole texts and stores them (a few numbers a
row); labels join those. Histograms of rule by bin are summed for the design, and joined
back as one row per stratum; what is tested is a histogram of steps. Neither grows with the
texts. The cutoffs (one stored row per stratum) are joined by stratum.

Defined results: null and empty texts have zero features and fail the base rule (fewer
than 50 words); unlabelled or contradictorily labelled rows are left out of the holdout;
without labels only the base rule rejects; an empty table gives no rows; further columns
are ignored. Texts of any length are taken whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, stored, texts

# The contract's white space and symbols.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"!?@^~=_+\\/{}[]"

MIN_WORDS = 50  # base rule: fewer words are rejected
MAX_REPEAT_PERCENT = 50  # base rule: a larger share of repeated words is rejected
BINS = 400  # candidate cutoffs of a rule
GOOD_WEIGHT = 20.0

#: Rules: name to SQL over the features; values lie in [0, 1].
RULES = {
    "symbols": "least(n_symbols / greatest(n_words, 1) / 2, 1)",
    "marks": "least(n_marks / greatest(n_words, 1) / 2, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}

_FEATURES = (
    "doc_id long, stratum string, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"
)
_NAMES = [part.split()[0] for part in _FEATURES.split(", ")]


def features_of(text: str) -> tuple[int, ...]:
    """Of one text, the numbers named in `_FEATURES` after the stratum."""
    body = text.encode()
    words = body.split()  # bytes split at exactly the six characters of SPACE
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    count = lambda some: len(body) - len(body.translate(None, some))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        count(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        count(CAPITALS),
        count(MARKS),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that the text has at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0  # ``end``: first word after what is covered so far
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + 3 - max(start, end)
            end = start + 3
    return covered


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [features_of(text) for text in batch.column(2).to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=_NAMES)


def features(docs: DataFrame, id_col="doc_id", text_col="text", stratum="lang") -> DataFrame:
    """One row of features per document, from its whole text."""
    base = texts(docs, id_col, text_col)
    if stratum is None or stratum not in docs.columns:
        rows = base.select("doc_id", F.lit("").alias("stratum"), "text")
    else:
        rows = docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            F.coalesce(docs[stratum].cast("string"), F.lit("")).alias("stratum"),
            F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        )
    return rows.mapInArrow(_measure, _FEATURES)


def most_failures(n: int, risk: float, level: float) -> int:
    """Largest k with P(Binomial(n, risk) <= k) <= level; -1 if there is none.

    Exactly then the Clopper-Pearson upper bound for k failures in n trials, at confidence
    ``1 - level``, does not exceed ``risk``.
    """
    if n == 0 or risk <= 0:
        return -1
    if risk >= 1:
        return n
    total, k = 0.0, -1
    ratio = math.log(risk) - math.log1p(-risk)
    log_term = n * math.log1p(-risk)
    while k < n:
        total += math.exp(log_term)
        if total > level:
            return k
        k += 1
        log_term += math.log((n - k) / (k + 1)) + ratio if k < n else 0.0
    return n


def design(good: dict[str, list[int]], bad: dict[str, list[int]]) -> list[dict[str, int]]:
    """A path of cutoff vectors, smallest rejected bin by rule, from mild to strict.

    ``good[rule][i]`` and ``bad[rule][i]`` count texts whose value lies in bin i; cutoff i
    rejects bins i and above, `BINS` rejects nothing, and bin 0 (the value 0) is never
    rejected. Every step lowers the cutoff of one rule to where it catches most bad texts
    for each good one; the path ends when no bad text is left to catch. A cutoff with
    empty bins below it moves to the middle of that gap.
    """
    at = dict.fromkeys(good, BINS)
    path = [dict(at)]

    def next_step(rule: str) -> tuple[float, int]:
        """Best ratio below the present cutoff and where it is reached."""
        best, found, caught, lost = 0.0, 0, 0, 0
        for i in range(at[rule] - 1, 0, -1):
            caught, lost = caught + bad[rule][i], lost + good[rule][i]
            if caught / (lost + 1) > best:
                best, found = caught / (lost + 1), i
        return best, found

    steps = {rule: next_step(rule) for rule in at}
    while max(ratio for ratio, _ in steps.values()) > 0:
        rule = max(steps, key=lambda r: (steps[r][0], -list(at).index(r)))
        cut = steps[rule][1]
        gap = 0  # half of the empty bins below goes to the rejected side
        while cut - gap > 1 and not good[rule][cut - gap - 1] + bad[rule][cut - gap - 1]:
            gap += 1
        at[rule] = cut - gap // 2
        path.append(dict(at))
        steps[rule] = next_step(rule)
    return path


def certified(
    tested_good: list[int],
    good: list[int],
    bad: list[int],
    risk: float,
    level: float,
    weight: float = GOOD_WEIGHT,
) -> int:
    """The step of a path to take; 0 rejects nothing.

    Lists count texts by the first step that rejects them: the good ones of the testing
    half, and good and bad ones of both. The last entry counts texts that no step rejects.
    """
    allowed = most_failures(sum(tested_good), risk, level)
    best, best_gain = 0, 0.0
    failed = lost = caught = 0
    for step in range(1, len(good) - 1):
        failed += tested_good[step]
        lost += good[step]
        caught += bad[step]
        if failed > allowed:
            break
        if caught - weight * lost > best_gain:
            best, best_gain = step, caught - weight * lost
    return best


def bin_of(value):
    """Bin 0 for the value 0, bin BINS - 1 for 1."""
    return F.when(value <= 0, 0).otherwise(
        F.least(1 + F.floor(value * (BINS - 1)).cast("int"), F.lit(BINS - 1))
    )


def cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    *,
    risk: float = 0.05,
    delta: float = 0.1,
) -> DataFrame:
    """Per stratum with labelled texts the smallest rejected bin of every rule.

    A stratum whose designing half is empty has no row: nothing is rejected there.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .drop("other")
    )
    bins = [bin_of(F.expr(sql)).alias(name) for name, sql in RULES.items()]
    tests = (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).alias("tests")
    # the base rule decides alone on what it rejects: the learned rules never see it
    held = (
        measured.where(~base_failed()).select("doc_id", "stratum", tests, *bins).join(known, "doc_id")
    )
    held = stored(held.drop("doc_id"), "quality-labelled")  # a few numbers per labelled text
    amounts = [F.sum(F.col("quality")).alias("good"), F.sum(1 - F.col("quality")).alias("bad")]
    counted = (
        held.where("NOT tests")
        .unpivot(["stratum", "quality"], list(RULES), "rule", "bin")
        .groupBy("stratum", "rule", "bin")
        .agg(*amounts)
    )

    def designed(group: pd.DataFrame) -> pd.DataFrame:
        good, bad = ({rule: [0] * BINS for rule in RULES} for _ in range(2))
        for rule, i, g, b in zip(group["rule"], group["bin"], group["good"], group["bad"]):
            good[rule][i], bad[rule][i] = int(g), int(b)
        path = design(good, bad)
        row = {"stratum": group["stratum"].iloc[0]}
        row |= {rule: [[step[rule] for step in path]] for rule in RULES}
        return pd.DataFrame(row)

    schema = "stratum string, " + ", ".join(f"{rule} array<int>" for rule in RULES)
    paths = stored(counted.groupBy("stratum").applyInPandas(designed, schema), "quality-paths")
    names = {rule: f"path_{rule}" for rule in RULES}
    rows = _with_cutoffs(held, paths, F.col("stratum"), names).where("path_symbols IS NOT NULL")
    # cutoffs fall along the path: as many steps as have a cutoff above the bin do not reject it
    spared = [F.expr(f"size(filter({names[rule]}, cut -> cut > {rule}))") for rule in RULES]
    steps = (
        rows.select("stratum", "tests", "quality", F.least(*spared).alias("step"))
        .groupBy("stratum", "step")
        .agg(*amounts, F.sum(F.when(F.col("tests"), F.col("quality")).otherwise(0)).alias("tested_good"))
    )
    steps = stored(steps, "quality-steps")
    tested = steps.where("tested_good > 0").agg(F.count_distinct("stratum")).first()[0]
    level = delta / max(1, tested)

    def select(key, counts: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        if not len(counts) or not len(path):
            return pd.DataFrame(columns=["stratum", *RULES])
        first = path.iloc[0]
        size = len(first[next(iter(RULES))])
        lists = {name: [0] * (size + 1) for name in ("tested_good", "good", "bad")}
        for name, values in lists.items():
            for step, n in zip(counts["step"], counts[name]):
                values[step] = int(n)
        step = certified(lists["tested_good"], lists["good"], lists["bad"], risk, level)
        return pd.DataFrame([{"stratum": first["stratum"]} | {rule: int(first[rule][step]) for rule in RULES}])

    schema = "stratum string, " + ", ".join(f"{rule} int" for rule in RULES)
    chosen = steps.groupBy("stratum").cogroup(paths.groupBy("stratum")).applyInPandas(select, schema)
    return stored(chosen, "quality-cutoffs")


def base_failed(renamed: dict[str, str] | None = None):
    n_words, repeated = (
        F.col((renamed or {}).get(name, name)) for name in ("n_words", "n_repeat_words")
    )
    return (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)


def _with_cutoffs(rows: DataFrame, chosen: DataFrame, stratum, names: dict) -> DataFrame:
    """``rows`` with the cutoffs of their stratum in the columns named by rule."""
    other = fresh(rows, "stratum_of_cutoffs")[0]
    cuts = chosen.select(F.col("stratum").alias(other), *[F.col(r).alias(n) for r, n in names.items()])
    return rows.join(cuts, stratum == F.col(other), "left").drop(other)


def _learned_failed(names: dict[str, str], renamed=None):
    """Whether a rule's value lies in or above its rejected bin."""
    failed = F.lit(False)
    for rule, sql in RULES.items():
        for name, other in (renamed or {}).items():
            sql = re.sub(rf"\b{name}\b", other, sql)
        failed = failed | (bin_of(F.expr(sql)) >= F.coalesce(F.col(names[rule]), F.lit(BINS)))
    return failed


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Features of every row of ``docs``, ``base_failed`` and the verdict ``kept``."""
    measured = stored(features(docs), "quality-features")
    names = {rule: f"cut_{rule}" for rule in RULES}
    failed = _learned_failed(names)
    rows = _with_cutoffs(measured, cutoffs(measured, labels, **options), F.col("stratum"), names)
    return rows.withColumn("base_failed", base_failed()).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~failed).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that `judged` keeps.

    A verdict depends on the text and the stratum only, so it is taken in the same pass
    that reads the rows and joins the cutoffs, which are learned before.
    """
    chosen = cutoffs(stored(features(docs), "quality-features"), labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features_of(text) for text in batch.column(0).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *columns], names=[*names, *measures]
            )

    measures = fresh(docs, *_NAMES[2:])
    names = list(docs.columns)
    fields = [T.StructField(name, T.LongType()) for name in measures]
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).alias(fresh(docs, "body")[0])
    measured = docs.select(text, *[docs[c] for c in names]).mapInArrow(
        run, T.StructType([*docs.schema.fields, *fields])
    )
    renamed = dict(zip(_NAMES[2:], measures))
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in names else F.lit("")
    cuts = dict(zip(RULES, fresh(measured, *(f"cut_{rule}" for rule in RULES))))
    kept = ~base_failed(renamed) & ~_learned_failed(cuts, renamed)
    return _with_cutoffs(measured, chosen, stratum, cuts).where(kept).select(*names)
