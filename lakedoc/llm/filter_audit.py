"""Operator 13: interaction audit of a list of filters, over every order of applying them.

Method: higher-order SQL folds. A document is only a mask of the filters that it fails, so
a part (a language) is at most 32 mask cells with their numbers of documents. Each cell
folds across the constant array of all 120 orders (`transform` over orders, `aggregate`
over the five steps), which gives 600 structs weighted by the cell's numbers; the cells of
a part are merged by elementwise sums (`zip_with` in an `aggregate`). DataFrame functions
only, no Python on the executors.

Plan: one scan turns every whole text into four bits and its SHA-256; texts never move.
Rows of the same id, part and text are counted before anything is shuffled, labels join by
id, and then everything is counted by text, part and mask. Filter E (equal to the text of
a smaller id) needs only the smallest id of a text and how many rows have it, which are
plain aggregates: a text that fills a third of the table is one row per map task. The cells
of a part are at most 32 structs.

Defined results: a null text is empty; a null part is the part ``''``; a row is a document,
also if its id is repeated (equal ids are not smaller) or null (such a row fails no E and
makes no other row fail it, and has no label); a document is good or toxic if any label
row of its id says so; an empty table gives no rows; further columns are ignored. Every
part has all 600 rows, zeros included. Texts of any length are taken whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakedoc.operators.joins import lookup_join

# The contract's filters and the characters that they look for.
LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
NOT_CAPITALS = r"[^A-Z]+"
SYMBOLS = r"[#$%&*|]"

ORDERS = ["".join(order) for order in permutations(LETTERS)]
WEIGHTS = ("n", "good", "toxic")

_STEP = "kept bigint, removed bigint, redundant bigint, good_lost bigint, toxic_lost bigint"
_STEPS = f"array<struct<{_STEP}>>"
_COUNTS = [part.split()[0] for part in _STEP.split(", ")]


def failures(docs: DataFrame, id_col="doc_id", text_col="text", part_col="lang") -> DataFrame:
    """One row per document: ``doc_id, part, digest, mask``; bit i is set where filter i of A-D fails."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.length(F.regexp_replace(text, NOT_CAPITALS, "")).alias("capitals"),
        F.length(text).alias("points"),
        text.rlike(SYMBOLS).alias("marked"),
    )
    measured = rows.select(
        "doc_id",
        "part",
        "digest",
        F.size("words").alias("words"),
        F.size(F.array_distinct("words")).alias("different"),
        F.col("capitals").cast("long").alias("capitals"),
        F.col("points").cast("long").alias("points"),
        "marked",
    )
    fails = [
        F.col("words") < 100,
        100 * F.col("different") < 80 * F.col("words"),
        100 * F.col("capitals") > 10 * F.col("points"),
        F.col("marked"),
    ]
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(fails)]
    return measured.select("doc_id", "part", "digest", sum(bits[1:], bits[0]).alias("mask"))


def label_flags(labels: DataFrame) -> DataFrame:
    """One row per labelled id: whether any of its rows says good, and whether any says toxic."""
    flag = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("long"), F.lit(0)))
    return (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(flag("quality").alias("is_good"), flag("toxic").alias("is_toxic"))
    )


def mask_cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask`` with all five bits, and how many documents, good and toxic ones there are."""
    counted = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    flags = label_flags(labels)
    weighed = lookup_join(counted, flags, ["doc_id"], "left").select(
        "doc_id",
        "part",
        "digest",
        "mask",
        "n",
        (F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )
    weights = F.struct(*WEIGHTS)
    alike = weighed.groupBy("digest", "part", "mask").agg(
        *(F.sum(w).alias(w) for w in WEIGHTS),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min("doc_id").alias("least"),
        F.min_by(weights, "doc_id").alias("first"),  # one row per id: the counts of the least
    )
    least = F.min("least").over(W.partitionBy("digest"))
    has_first = F.coalesce(F.col("least") == F.col("of_text"), F.lit(False))
    first = lambda w: F.when(has_first, F.col("first")[w]).otherwise(0)
    spared = {w: first(w) for w in WEIGHTS} | {"n": first("n") + F.col("unnamed")}
    cell = lambda mask, amounts: F.struct(mask.alias("mask"), *(v.alias(k) for k, v in amounts.items()))
    copies = {w: F.col(w) - spared[w] for w in WEIGHTS}
    both = F.array(cell(F.col("mask"), spared), cell(F.col("mask") + 16, copies))
    return (
        alike.withColumn("of_text", least)
        .select("part", F.inline(both))
        .groupBy("part", "mask")
        .agg(*(F.sum(w).alias(w) for w in WEIGHTS))
    )


def _counts(*values: Column) -> Column:
    return F.struct(*(v.cast("long").alias(name) for v, name in zip(values, _COUNTS)))


def folded(cell: Column, orders: Column) -> Column:
    """600 structs of one mask cell: its documents at every step of every order."""

    def step(state: Column, letter: Column) -> Column:
        fails = F.getbit(cell["mask"].cast("long"), letter) == 1
        here = fails & ~state["gone"]
        gone = state["gone"] | fails
        amount = lambda condition, w="n": F.when(condition, cell[w]).otherwise(0)
        now = _counts(
            amount(~gone), amount(here), amount(fails & state["gone"]),
            amount(here, "good"), amount(here, "toxic"),
        )
        return F.struct(gone.alias("gone"), F.concat(state["steps"], F.array(now)).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(_STEPS).alias("steps"))
    walk = lambda order: F.aggregate(order, start, step, lambda state: state["steps"])
    return F.flatten(F.transform(orders, walk))


def audit(cells: DataFrame) -> DataFrame:
    """The report of `filter_audit` from ``part, mask, n, good, toxic``."""
    orders = F.lit([[LETTERS.index(letter) for letter in order] for order in ORDERS])
    zeros = F.array_repeat(_counts(*[F.lit(0)] * len(_COUNTS)), len(ORDERS) * len(LETTERS)).cast(_STEPS)
    add = lambda a, b: _counts(*(a[c] + b[c] for c in _COUNTS))
    merged = lambda total, cell: F.zip_with(total, folded(cell, orders), add)
    parts = cells.groupBy("part").agg(
        F.collect_list(F.struct("mask", *WEIGHTS)).alias("cells")  # at most 32 structs
    )
    steps = parts.select(
        "part",
        F.transform(
            F.lit([1 << i for i in range(len(LETTERS))]),
            lambda only: F.aggregate(
                "cells",
                F.lit(0).cast("long"),
                lambda total, cell: total
                + F.when(cell["mask"] == only, cell["n"]).otherwise(0),
            ),
        ).alias("alone"),
        F.posexplode(F.aggregate("cells", zeros, merged)).alias("pos", "at"),
    )
    names = F.lit(ORDERS)
    order = F.get(names, F.floor(F.col("pos") / len(LETTERS)).cast("int"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    numbered = steps.select(
        "part", "alone", "at", order.alias("filter_order"), (F.col("pos") % len(LETTERS) + 1).alias("step")
    ).withColumn("letter", letter)
    every_order = W.partitionBy("part", "letter")
    return numbered.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        "at.kept",
        "at.removed",
        "at.redundant",
        F.get("alone", F.ascii("letter") - ord("A")).alias("unique_fails"),
        "at.good_lost",
        "at.toxic_lost",
        F.sum("at.removed").over(every_order).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row per part, order of the filters and step; see the module for the filters and columns."""
    return audit(mask_cells(failures(docs, **columns), labels))


ORACLE_SQL = r"""
WITH rows AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
least AS (SELECT body, min(doc_id) AS least FROM rows GROUP BY body),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
          FROM labels GROUP BY doc_id),
words AS (
  SELECT doc_id, part, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words FROM rows),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(body, '[^A-Z]+', '', 'g')) > 10 * length(body),
    regexp_matches(body, '[#$%&*|]'),
    coalesce(doc_id > least, false)] AS f
  FROM words JOIN least USING (body) LEFT JOIN flags USING (doc_id)),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
          FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
         ascii(substr(filter_order, step, 1)) - 64 AS own,
         [ascii(substr(filter_order, i, 1)) - 64 FOR i IN range(1, step)] AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
seen AS (
  SELECT part, filter_order, step, letter, n, good, toxic, f[own] AS hit,
         len([i FOR i IN earlier IF f[i]]) > 0 AS gone,
         f[own] AND len([x FOR x IN f IF x]) = 1 AS alone
  FROM cells, steps),
report AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept,
         coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM report
"""
