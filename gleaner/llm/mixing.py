"""Mixing sources to target weights: temperature shares under an entropy or repetition limit, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.llm.common import materialize, materialize_counted

#: Blocks of a source. A source's tokens are permuted block by block, so that the budget is met to about a block.
BLOCKS = 256
#: A schedule of at most so many rows is broadcast; a longer one is joined by a shuffle, in which a source has BLOCKS keys.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Target:
    """entropy: what the weights' entropy is raised to, as a share of the most there can be; repetition: how often a source may be read at most.

    budget: tokens to realise; None: as many as let every source be read at least once.
    """

    entropy: float | None = 0.9
    repetition: float | None = 4.0
    budget: float | None = None
    seed: int = 17


def tempered(tokens: np.ndarray, exponent: float, count: np.ndarray | None = None) -> np.ndarray:
    """Shares to the power of exponent, normalised over sources of which count[i] have tokens[i]; sources without tokens get nothing."""
    tokens = np.asarray(tokens, float)
    count = np.ones(len(tokens)) if count is None else count
    raw = np.where(tokens > 0, (tokens / max(tokens.max(initial=0.0), 1e-300)) ** exponent, 0.0)
    total = float((raw * count).sum())
    return raw / total if total else raw


def entropy(weights: np.ndarray, count: np.ndarray | None = None) -> float:
    w = np.asarray(weights, float)
    live = w > 0
    return float(-(w[live] * np.log(w[live]) * (1 if count is None else count[live])).sum())


def budget_of(tokens: np.ndarray, weights: np.ndarray, target: Target) -> float:
    if target.budget is not None:
        return target.budget
    return float(max((t / w for t, w in zip(tokens, weights) if w > 0), default=0.0))


def repetition(tokens: np.ndarray, weights: np.ndarray, target: Target) -> float:
    budget = budget_of(tokens, weights, target)
    return float(max((budget * w / t for t, w in zip(tokens, weights) if t > 0), default=0.0))


def solve(tokens: np.ndarray, target: Target, rounds: int = 60, count: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The exponent in [0, 1] and its weights; count: how many sources have each number of tokens (1 by default).

    The exponent is bisected: the largest one that reaches the target entropy (1, the natural shares, if they do), then raised
    as far as the repetition limit asks, which has the last word. At exponent 1 nothing is read more often than the budget asks for.
    """
    tokens = np.asarray(tokens, float)
    count = np.ones(len(tokens)) if count is None else np.asarray(count, float)
    live = float(count[tokens > 0].sum())
    if live < 2:
        return 1.0, tempered(tokens, 1.0, count)

    def bisect(good_low) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good_low(mid) else (lo, mid)
        return (lo + hi) / 2

    exponent = 1.0
    if target.entropy is not None:
        aim = target.entropy * math.log(live)
        if entropy(tempered(tokens, 1.0, count), count) < aim:
            exponent = bisect(lambda a: entropy(tempered(tokens, a, count), count) >= aim)
    if target.repetition is not None and repetition(tokens, tempered(tokens, exponent, count), target) > target.repetition:
        least = bisect(lambda a: repetition(tokens, tempered(tokens, a, count), target) > target.repetition)
        exponent = max(exponent, least)
    return exponent, tempered(tokens, exponent, count)


def n_tokens(text: str | Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def block_of(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(BLOCKS)).cast("int")


def plan(docs: DataFrame, target: Target = Target(), key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(report, schedule, rows of schedule): report (source, tokens, share, weight, repetition, exponent) and schedule (source, block, epoch, place, at).

    Every source is cut into BLOCKS blocks by a hash of the key. Each epoch permutes a source's blocks anew by a hash: place is a block's turn in it, from 0.
    Whole epochs take all blocks, and the last one takes blocks in their turn while the tokens before them are short of what is left of the source's
    budget. at is the share of its budget that a source has been read before the block: in the order of at, all sources run through together.
    A null source is one of its own; a source without any token is read once. The driver sees how many sources have each number
    of tokens: those numbers are different, so there are at most the square root of twice all tokens, however many sources there are.
    """
    sized = docs.select(docs[source].alias("source"), block_of(docs[key], target.seed).alias("block"), n_tokens(docs[text]).alias("tokens"))
    blocks, _ = materialize(sized.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    sizes = sources.groupBy("tokens").agg(F.count("*").alias("n")).orderBy("tokens").toPandas()
    tokens, count = sizes["tokens"].to_numpy(float), sizes["n"].to_numpy(float)
    exponent, weights = solve(tokens, target, count=count)
    budget, total = budget_of(tokens, weights, target), float((tokens * count).sum())
    top = float(tokens.max(initial=0.0)) or 1.0
    scale = float((np.where(tokens > 0, (tokens / top) ** exponent, 0.0) * count).sum()) or 1.0
    t = F.col("tokens").cast("double")
    weight = F.when(t > 0, F.pow(t / top, F.lit(exponent)) / scale).otherwise(0.0)
    report = sources.select("source", "tokens", (t / (total or 1.0)).alias("share"), weight.alias("weight"), F.when(t > 0, F.lit(budget) * weight / t).otherwise(1.0).alias("repetition"), F.lit(exponent).alias("exponent"))
    report, _ = materialize(report, "report")

    own = report.select(F.col("source").alias("s"), "repetition", F.col("tokens").alias("of_source"))
    joined = blocks.join(own, F.col("source").eqNullSafe(F.col("s"))).withColumn("whole", F.floor(F.col("repetition") + F.lit(1e-9)).cast("long"))
    epochs = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "whole")))
    turn = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(target.seed)), "block")  # at most BLOCKS rows
    before = F.coalesce(F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = (F.col("repetition") - F.col("whole")) * F.col("of_source")
    at = (F.col("epoch") * F.col("of_source") + F.col("before")) / F.greatest(F.col("repetition") * F.col("of_source"), F.lit(1.0))
    schedule = epochs.withColumn("before", before).withColumn("place", F.row_number().over(turn) - 1).where((F.col("epoch") < F.col("whole")) | (F.col("before") < left - F.lit(0.5)))
    schedule, _, n = materialize_counted(schedule.select("source", "block", "epoch", "place", at.alias("at")), "schedule")
    return report, schedule, n


def _read(tagged: DataFrame, schedule: DataFrame, n: int, how: str) -> DataFrame:
    """tagged (__source, __block, ...) with epoch, place and at of each time that its block is read."""
    table = schedule.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "epoch", "place", "at")
    table = F.broadcast(table) if n <= BROADCAST_ROWS else table
    return tagged.join(table, tagged["__source"].eqNullSafe(table["__s"]) & (tagged["__block"] == table["__b"]), how).drop("__s", "__b")


def weigh(docs: DataFrame, target: Target = Target(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Rows (key, source, tokens, weight, repetition, block, epoch, place, at), one for each time that the mix reads a row of docs; see plan.

    A row that isn't read, as the budget doesn't reach its block, comes once with a null epoch. Repeated rows and null keys stay and share a block;
    a null or empty text has no tokens and is read as its block is. Other columns are ignored.
    """
    report, schedule, n = plan(docs, target, key, source, text)
    tagged = docs.select(docs[key].alias(key), docs[source].alias("__source"), block_of(docs[key], target.seed).alias("__block"), n_tokens(docs[text]).alias("tokens"))
    found = _read(tagged, schedule, n, "left")
    own = report.select(F.col("source").alias("__s"), "weight", "repetition")
    if n <= BROADCAST_ROWS:  # a source has a row of the schedule at least, or none is read
        found = found.join(F.broadcast(own), found["__source"].eqNullSafe(own["__s"]))
    else:  # a source's rows are in as many keys as it has blocks
        own = own.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
        found = found.join(own, found["__source"].eqNullSafe(own["__s"]) & (found["__block"] == own["__b"]))
    return found.select(key, F.col("__source").alias("source"), "tokens", "weight", "repetition", F.col("__block").alias("block"), "epoch", "place", "at")


def realise(docs: DataFrame, target: Target = Target(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: each row of docs, all its columns, as often as its block is read (not at all if its block's turn doesn't come).

    Rows of one key, and those of null, share a block, so repeated rows are read as often as each other; a null or empty text has no tokens. No rows give none.
    Columns may have any names; none but key, source and text is looked at.
    """
    _, schedule, n = plan(docs, target, key, source, text)
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row")
    tagged = docs.select(whole, docs[source].alias("__source"), block_of(docs[key], target.seed).alias("__block"))
    return _read(tagged, schedule, n, "inner").select(*(F.col("__row")[c].alias(c) for c in docs.columns))
