"""Filter interaction audit: what each filter removes, in every order of the filters, from a histogram of failure masks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialize

#: What parts words.
_SPACES = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The number of orders grows with the factorial of the filters.
MOST_FILTERS = 6


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that isn't null: short, repetitive, many capitals, signs."""
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    n = F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n,
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def facts(names: str) -> tuple[list[tuple], list[tuple]]:
    """(effects, orders) of filters whose bits are in the order of names, by going through all orders.

    effects: (mask, before, bit, kept, removed, redundant, alone, times) for a document that fails the filters of mask, at the step of the filter
    `bit` when those of `before` have run; times is the number of orders in which this filter removes it. orders: (filter_order, step, before, bit).
    """
    bit = {x: 1 << i for i, x in enumerate(names)}
    orders = [("".join(o), i + 1, sum(bit[x] for x in o[:i]), bit[o[i]]) for o in permutations(names) for i in range(len(o))]
    places = sorted({(before, own) for *_, before, own in orders})
    effects = []
    for mask in range(1 << len(names)):
        times = {b: sum(own == b and bool(mask & b) and not mask & before for *_, before, own in orders) for b in bit.values()}
        for before, own in places:
            fails, gone = bool(mask & own), bool(mask & before)
            effects.append((mask, before, own, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == own), times[own]))
    return effects, orders


def masks(docs: DataFrame, tests: Callable[[Column], dict[str, Column]], key: str, part: str, text: str) -> DataFrame:
    """Rows (key, part, digest, mask): the text's failure mask, a bit a condition, and its SHA-256, by which equal texts are told."""
    t = F.coalesce(docs[text], F.lit(""))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(tests(t).values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return docs.select(docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def histogram(docs: DataFrame, labels: DataFrame, tests: Callable[[Column], dict[str, Column]] = conditions, key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """Rows (part, mask, n, good, toxic): how many rows of each part fail exactly the filters of mask; the last bit is that of duplicates.

    A row is a duplicate if a row of smaller key has the same text; null keys come after all others, and rows of one key don't count as smaller.
    good, toxic: rows whose key labels(key, quality, toxic) marks with 1 (in one row of labels at least). A null text is an empty one; null and empty
    parts are one part. Other columns, whatever their names, are ignored.

    Texts are read once. Rows of a few dozen bytes are shuffled: by key and digest, so that a group of copies is spread over its keys; the smallest key of
    a digest is a partial aggregate, and joined back only by (digest, key), which the first row of a text alone meets.
    """
    last = len(tests(F.lit("")))
    spark = docs.sparkSession
    rows, written = materialize(masks(docs, tests, key, part, text).groupBy("key", "digest", "part", "mask").agg(F.count("*").alias("n")), "masks")
    first = rows.groupBy("digest").agg(F.min("key").alias("least")).select(F.col("digest").alias("__digest"), "least", F.lit(True).alias("first"))
    told = rows.join(first, (F.col("digest") == F.col("__digest")) & F.col("key").eqNullSafe(F.col("least")), "left")
    # null keys meet no label, and are spread over the tasks
    spread = F.when(F.col("key").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    marks = labels.where(labels[key].isNotNull()).groupBy(labels[key].alias("__key")).agg(F.max((labels["quality"] == 1).cast("long")).alias("good"), F.max((labels["toxic"] == 1).cast("long")).alias("toxic"))
    told = told.withColumn("__spread", spread).join(marks.withColumn("__none", F.lit(0).cast("long")), (F.col("key") == F.col("__key")) & (F.col("__spread") == F.col("__none")), "left")
    mask = F.col("mask") + F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << last))
    n = F.col("n")
    cells, _ = materialize(
        told.groupBy("part", mask.alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic")), "cells"
    )
    discard(spark, written)
    return cells


def audit(docs: DataFrame, labels: DataFrame, tests: Callable[[Column], dict[str, Column]] = conditions, duplicates: str = "E", key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row a part, order and step.

    The filters are those of tests and, last, that of duplicates, each named by a letter. kept, removed: rows left after the step, and removed by it;
    redundant: rows that fail its filter but were gone before; unique_fails: rows that fail this filter alone; good_lost, toxic_lost: removed rows marked so
    (histogram says how); shapley: what the filter removes, summed over all orders. All orders are enumerated on the cells, 2 ** filters a part, never on rows.
    An empty table has no parts, and so no rows. The tables of effects and orders hang on the number of filters alone, and are broadcast.
    """
    names = "".join(tests(F.lit(""))) + duplicates
    if len(names) > MOST_FILTERS or len(set(names)) != len(names):
        raise ValueError(f"filters need different letters, and there may be {MOST_FILTERS} at most")
    spark = docs.sparkSession
    effects, orders = facts(names)
    effects = spark.createDataFrame(effects, "mask int, before int, bit int, kept long, removed long, redundant long, alone long, times long")
    orders = spark.createDataFrame(orders, "filter_order string, step int, before int, bit int")
    met = histogram(docs, labels, tests, key, part, text).join(F.broadcast(effects), "mask")
    n, removed = F.col("n"), F.col("removed")
    steps = met.groupBy("part", "before", "bit").agg(
        F.sum(n * F.col("kept")).alias("kept"), F.sum(n * removed).alias("removed"), F.sum(n * F.col("redundant")).alias("redundant"), F.sum(n * F.col("alone")).alias("unique_fails"),
        F.sum(F.col("good") * removed).alias("good_lost"), F.sum(F.col("toxic") * removed).alias("toxic_lost"), F.sum(n * F.col("times")).alias("shapley"),
    )
    return steps.join(F.broadcast(orders), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
