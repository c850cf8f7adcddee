"""Graph sequences over an integer or time column, and cascades of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.session import discard, materialize


def split_windows(df: DataFrame, split: str, window: int, jump: int, start: int | None = None, end: int | None = None, bucket: str = "bucket") -> DataFrame:
    """Each row once for each window it is in. Window i covers [start + i * jump, start + i * jump + window).

    jump = window tumbles, jump < window slides, jump = 0 expands: window i then holds the rows up to start + (i + 1) * window.
    Rows outside [start, end], both included, go; the bounds are the column's least and largest values unless given. Empty windows have no rows.
    """
    value = F.col(split).cast("long")
    if start is None or end is None:
        low, high = df.agg(F.min(value), F.max(value)).first()
        start, end = low if start is None else start, high if end is None else end
    if start is None:
        return df.withColumn(bucket, F.lit(None).cast("long")).limit(0)
    at = value - F.lit(start)
    rows = df.where(value.between(start, end))
    if jump == 0:
        last = (end - start) // window
        return rows.withColumn(bucket, F.explode(F.sequence(F.floor(at / window), F.lit(last).cast("long"))))
    first = F.when(at < window, F.lit(0).cast("long")).otherwise(F.floor((at - window) / jump) + 1)
    last = F.least(F.floor(at / jump), F.lit((end - start) // jump).cast("long"))
    return rows.withColumn("__lo", first).withColumn("__hi", last).where("__lo <= __hi").withColumn(bucket, F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def split_intervals(df: DataFrame, split: str, intervals: Sequence[tuple[int, int]], bucket: str = "bucket") -> DataFrame:
    """Each row once for each half-open interval [low, high) it is in; intervals may overlap. They are literals, so no join is needed."""
    value = F.col(split).cast("long")
    inside = F.array(*(F.when((value >= lo) & (value < hi), F.lit(i).cast("long")) for i, (lo, hi) in enumerate(intervals)))
    return df.withColumn(bucket, F.explode(F.array_compact(inside)))


def split_groups(df: DataFrame, group: str, bucket: str = "bucket") -> DataFrame:
    return df.withColumn(bucket, F.col(group))


def sequence_edges(windows: DataFrame, source: str, target: str, bucket: str = "bucket") -> DataFrame:
    """The graph of each window: distinct undirected edges (bucket, src, dst), src < dst."""
    s, t = F.col(source), F.col(target)
    return windows.where(s != t).select(bucket, F.least(s, t).alias("src"), F.greatest(s, t).alias("dst")).distinct()


def each_window(windows: DataFrame, bucket: str = "bucket"):
    """(bucket, its rows) one window after another, in order; the list of buckets is all that comes to the driver."""
    for r in windows.select(bucket).distinct().orderBy(bucket).collect():
        yield r[bucket], windows.where(F.col(bucket).eqNullSafe(F.lit(r[bucket]))).drop(bucket)


def cascade_edges(events: DataFrame, key: str, source: str, target: str, start: str, duration: str | Column, wait: int) -> DataFrame:
    """Pairs (a, b) of events where b starts at a's target, no earlier than a ends and at most `wait` after.

    Time is cut into cells as wide as the wait, so the range condition becomes an equi-join on place and cell.
    """
    d = F.col(duration) if isinstance(duration, str) else duration
    cell = max(int(wait), 1)
    a = events.select(F.col(key).alias("a"), F.col(target).alias("place"), (F.col(start) + d).alias("ends"))
    a = a.withColumn("cell", F.explode(F.array(F.floor(F.col("ends") / cell), F.floor(F.col("ends") / cell) + 1)))
    b = events.select(F.col(key).alias("b"), F.col(source).alias("place"), F.col(start).alias("starts")).withColumn("cell", F.floor(F.col("starts") / cell))
    hit = (F.col("starts") >= F.col("ends")) & (F.col("starts") - F.col("ends") <= wait) & (F.col("a") != F.col("b"))
    return a.join(b, ["place", "cell"]).where(hit).select("a", "b")


def cascades(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Rows (root, event): all events that an event without a predecessor reaches, itself included, if there are others."""
    spark = edges.sparkSession
    roots = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    reached, path = materialize(roots.select(F.col("a").alias("root"), F.col("a").alias("event")), "reached")
    frontier = reached
    paths = [path]
    for _ in range(max_rounds):
        step = frontier.join(edges, F.col("event") == F.col("a")).select("root", F.col("b").alias("event")).distinct()
        new, path = materialize(step.join(reached, ["root", "event"], "left_anti"), "reached")
        paths.append(path)
        if new.isEmpty():
            discard(spark, path)
            return reached
        frontier = new
        reached = reached.unionByName(new)
    raise RuntimeError("cascades did not end")
