"""Metrics over crawl logs, and curves, aggregates, winners and missing runs over histories.

A crawl log has a row (run_id, step, node); a history a row (graph, crawler, metric, budget, instance, step, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("graph", "crawler", "metric", "budget")


def exponential_steps(budget: int) -> list[int]:
    """Steps at which metrics are taken: a batch is a twentieth of what is done, one at least; the last one is the budget."""
    out, at = [], 0
    while at < budget:
        at = min(budget, at + max(1, int(at * 0.05)))
        out.append(at)
    return out


def uniform_steps(budget: int, batch: int) -> list[int]:
    return list(range(batch, budget, batch)) + [budget] if budget else []


def found_by_step(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (run_id, step, crawled, hits): targets among the nodes crawled up to each step."""
    y = labels.select(F.col("id").alias("node"), F.coalesce("y", F.lit(0)).alias("y"))
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    hits = log.select("run_id", "step", "node").join(y, "node", "left").select("run_id", "step", F.coalesce("y", F.lit(0)).alias("y"))
    return hits.select("run_id", "step", F.count("*").over(w).alias("crawled"), F.sum("y").over(w).cast("long").alias("hits"))


def scores(found: DataFrame, n_targets: Column) -> DataFrame:
    """found (crawled, hits) with precision, recall and f1; a score without a base is null."""
    return (
        found.withColumn("precision", F.col("hits") / F.nullif(F.col("crawled"), F.lit(0)))
        .withColumn("recall", F.col("hits") / F.nullif(n_targets, F.lit(0)))
        .withColumn("f1", 2 * F.col("hits") / F.nullif(n_targets + F.col("crawled"), F.lit(0)))
    )


def observed_by_step(log: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Rows (run_id, step, observed): nodes seen but not crawled after each step, from both-way edges (src, dst)."""
    seen = log.join(adjacency, F.col("node") == F.col("src")).groupBy("run_id", F.col("dst").alias("node")).agg(F.min("step").alias("seen"))
    own = log.select("run_id", "node", F.col("step").alias("crawled"))
    gone = seen.join(own, ["run_id", "node"], "left").where("crawled is null or crawled > seen")
    delta = gone.select("run_id", F.col("seen").alias("step"), F.lit(1).alias("d")).unionAll(gone.where("crawled is not null").select("run_id", F.col("crawled").alias("step"), F.lit(-1).alias("d")))
    change = delta.groupBy("run_id", "step").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return log.join(change, ["run_id", "step"], "left").select("run_id", "step", F.sum(F.coalesce("d", F.lit(0))).over(w).alias("observed"))


def parts_by_step(log: DataFrame, adjacency: DataFrame, labels: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Rows (run_id, step, part, size, hits) after each step: of the nodes crawled, of those observed (seen, not crawled), of both together, and of answers.

    log: (run_id, step, node); adjacency: both-way edges (src, dst); labels (id, y); answers: (run_id, step, node), the nodes that a run gives as its answer at a step.
    """
    y = labels.select(F.col("id").alias("node"), F.coalesce("y", F.lit(0)).cast("long").alias("y"))
    own = log.select("run_id", "node", F.col("step").alias("crawled"))
    seen = log.join(adjacency, F.col("node") == F.col("src")).groupBy("run_id", F.col("dst").alias("node")).agg(F.min("step").alias("seen"))
    both = own.join(seen, ["run_id", "node"], "full").join(y, "node", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    change = lambda part, step, sign: F.struct(F.lit(part).alias("part"), step.alias("step"), F.lit(sign).cast("long").alias("n"), (F.col("y") * sign).alias("hits"))
    waits = F.col("seen").isNotNull() & (F.col("crawled").isNull() | (F.col("crawled") > F.col("seen")))
    events = F.array(
        F.when(F.col("crawled").isNotNull(), change("crawled", F.col("crawled"), 1)), F.when(waits, change("observed", F.col("seen"), 1)), F.when(waits & F.col("crawled").isNotNull(), change("observed", F.col("crawled"), -1)),
        change("nodes", F.least(F.coalesce("crawled", "seen"), F.coalesce("seen", "crawled")), 1),
    )
    moved = both.select("run_id", F.explode(F.array_compact(events)).alias("e")).groupBy("run_id", "e.part", "e.step").agg(F.sum("e.n").alias("n"), F.sum("e.hits").alias("h"))
    grid = log.select("run_id", "step").distinct().withColumn("part", F.explode(F.array(F.lit("crawled"), F.lit("observed"), F.lit("nodes"))))
    w = Window.partitionBy("run_id", "part").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(w)
    out = grid.join(moved, ["run_id", "part", "step"], "left").select("run_id", "step", "part", total("n").alias("size"), total("h").alias("hits"))
    if answers is None:
        return out
    given = answers.select("run_id", "step", "node").distinct().join(y, "node", "left").groupBy("run_id", "step").agg(F.count("*").alias("size"), F.sum(F.coalesce("y", F.lit(0))).alias("hits"))
    return out.unionByName(given.select("run_id", "step", F.lit("answer").alias("part"), "size", "hits"))


def part_scores(parts: DataFrame, n_targets: Column) -> DataFrame:
    """parts_by_step with precision, recall and f1 of each part; a score without a base is null."""
    return scores(parts.withColumn("crawled", F.col("size")), n_targets).drop("crawled")


def metric_values(log: DataFrame, metrics: dict[str, object], steps: Sequence[int] | None = None) -> DataFrame:
    """Rows (run_id, step, metric, value) of metrics: name to a function of the log that gives rows (run_id, step, value); at some steps only, if given."""
    found = None
    for name, metric in metrics.items():
        own = metric(log).select("run_id", "step", F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        found = own if found is None else found.unionByName(own)
    return found if steps is None else found.where(F.col("step").isin(list(steps)))


def merged(stores: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Histories merged by content, in the order given: curves that an earlier one has are left out, others get the next instance numbers."""
    out = stores[0]
    for other in stores[1:]:
        out = out.unionByName(next_instances(out, other, keys).select(*out.columns))
    return out


def curve_measures(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, aucc, waucc, tc) of each curve (step, value), steps from 0 on.

    aucc: area by trapezoids over steps as shares of the last one, with a first triangle from 0. waucc: mean of the trapezoids' heights, weighted by width
    over step; before them the first value counts in full, with weight 1, unless the curve starts at step 0. tc: the last value.
    """
    w = Window.partitionBy(*keys).orderBy("step")
    x, y = F.col("step").cast("double"), F.col("value")
    lag = history.select(*keys, "step", "value", F.lag(x).over(w).alias("x0"), F.lag(y).over(w).alias("y0"))
    first = F.col("x0").isNull()
    high = (y + F.col("y0")) / 2
    area = F.sum(F.when(first, x * y / 2).otherwise((x - F.col("x0")) * high)) / F.nullif(F.max(x), F.lit(0.0))
    weight = F.when(first, (x > 0).cast("double")).otherwise((x - F.col("x0")) / x)
    return lag.groupBy(*keys).agg(
        area.alias("aucc"), (F.sum(weight * F.when(first, y).otherwise(high)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("waucc"), F.max_by("value", "step").alias("tc")
    )


def aggregated(measures: DataFrame, keys: Sequence[str], value: str, median: bool = False) -> DataFrame:
    """Rows (keys, n, mean, std): over instances; the deviation is of the population."""
    middle = F.median(value) if median else F.avg(value)
    return measures.groupBy(*keys).agg(F.count("*").alias("n"), middle.alias("mean"), F.stddev_pop(value).alias("std"))


def winners(means: DataFrame, n_crawlers: int, metrics: Sequence[str] = ()) -> DataFrame:
    """Rows (crawler, wins) over means (graph, crawler, mean): graphs that lack a crawler don't count; ties go to the crawler that sorts last."""
    keys = ["graph", *metrics]
    real = means.where(F.col("mean").isNotNull() & ~F.isnan("mean"))
    best = real.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.struct("mean", "crawler")).alias("best")).where(F.col("n") == n_crawlers)
    return best.groupBy(F.col("best.crawler").alias("crawler")).agg(F.count("*").alias("wins"))


def missing(plan: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, missing) of plan (keys, planned): how many instances are still to run."""
    have = history.select(*keys, "instance").distinct().groupBy(*keys).agg(F.count("*").alias("have"))
    left = plan.join(have, list(keys), "left").withColumn("missing", F.col("planned") - F.coalesce("have", F.lit(0)))
    return left.where("missing > 0").select(*keys, "missing")


def pivot(means: DataFrame, graphs: Sequence[str]) -> DataFrame:
    """A row a crawler, a column a graph."""
    return means.groupBy("crawler").pivot("graph", list(graphs)).agg(F.first("mean"))


def mean_curve(history: DataFrame, keys: Sequence[str], relative: bool = False) -> DataFrame:
    """Rows (keys, x, mean, std, n) at each step; relative: steps as shares of the last one."""
    last = history.groupBy(*keys).agg(F.max("step").alias("__last"))
    rows = history.join(last, list(keys)).withColumn("x", F.col("step") / F.col("__last") if relative else F.col("step").cast("double"))
    return rows.groupBy(*keys, "x").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))


def next_instances(history: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New instances renumbered after those that a history has; curves equal to one it has are left out."""
    mark = lambda h: h.groupBy(*keys, "instance").agg(F.sort_array(F.collect_list(F.struct("step", "value"))).alias("curve"))
    old = mark(history).select(*keys, F.xxhash64("curve").alias("mark")).distinct()
    fresh = mark(new).withColumn("mark", F.xxhash64("curve")).join(old, [*keys, "mark"], "left_anti").dropDuplicates([*keys, "mark"])
    top = history.groupBy(*keys).agg((F.max("instance") + 1).alias("first"))
    numbered = fresh.join(top, list(keys), "left").withColumn("to", F.coalesce("first", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys).orderBy("instance")) - 1)
    return new.join(numbered.select(*keys, "instance", "to"), [*keys, "instance"]).withColumn("instance", F.col("to")).drop("to")
