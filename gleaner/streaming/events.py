"""Windows over a stream of events, and crawls that advance by a stream of ticks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.crawl.policies import POLICIES
from gleaner.crawl.run import Declaration, collect_graph
from gleaner.crawl.state import Crawl, Csr

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
STEPS = "run_id string, step int, node long, y int, n_observed int"


def read_events(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """Events of Parquet files as they come into a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows (start, event_type, events, total) a window and type; events later than the watermark are dropped."""
    w = F.window("ts", window, slide or window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("w.start", "event_type", "events", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Rows (user_id, start, end, events): sessions that end after a gap."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", s.alias("s")).agg(F.count("*").alias("events")).select("user_id", "s.start", "s.end", "events")


def crawl_ticks(ticks: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Rows STEPS from a stream of ticks (run_id, declaration, seed, rng_seed, budget): each tick advances its run by its budget.

    A run's crawl is the state of its key, kept by Spark between triggers. The graph is broadcast after its size is checked.
    """
    sent = ticks.sparkSession.sparkContext.broadcast(collect_graph(edges, labels))
    return ticks.groupBy("run_id").applyInPandasWithState(
        lambda key, frames, state: advance(key, frames, state, sent.value), STEPS, "state binary", "append", GroupStateTimeout.NoTimeout
    )


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, graph: Csr) -> Iterator[pd.DataFrame]:
    """Advance one run; the graph isn't part of the state."""
    import numpy as np

    crawl = policy = None
    if state.exists:
        crawl, policy, upcoming = pickle.loads(state.get[0])
        crawl.graph = graph
        policy.state = crawl
    rows = []
    for frame in frames:
        for t in frame.itertuples(index=False):
            if crawl is None:
                d = Declaration.from_json(t.declaration)
                crawl = Crawl(graph)
                policy = POLICIES[d.kind](crawl, np.random.Generator(np.random.PCG64(int(t.rng_seed))), **d.options)
                upcoming = int(np.searchsorted(graph.ids, int(t.seed)))
                crawl.observe(upcoming)
            for _ in range(int(t.budget)):
                if upcoming is None:
                    break
                new = crawl.crawl(upcoming)
                y = int(graph.y[upcoming])
                rows.append((key[0], len(crawl.order), int(graph.ids[upcoming]), None if y < 0 else y, len(crawl.observed)))
                policy.after(upcoming, new)
                upcoming = policy.next()
    if crawl is not None:
        crawl.graph, policy.state = None, None
        state.update((pickle.dumps((crawl, policy, upcoming)),))
    yield pd.DataFrame(rows, columns=["run_id", "step", "node", "y", "n_observed"])
