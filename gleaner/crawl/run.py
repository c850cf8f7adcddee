"""Runs: declared as rows, crawled in parallel, one task a group of runs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.crawl.policies import POLICIES
from gleaner.crawl.state import Crawl, Csr

LOG = "run_id string, step int, node long, y int, score double, n_observed int, n_new int, weights array<double>"
#: A graph of more edges isn't held in each task: see collect_graph.
MAX_EDGES = 50_000_000


@dataclass(frozen=True)
class Declaration:
    """What makes a run: a class name and its options, any of bool, int, float, str, list, tuple, dict or None. The key is a hash of the canonical JSON."""

    kind: str
    options: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "options": self.options}, sort_keys=True, separators=(",", ":"))

    @classmethod
    def from_json(cls, text: str) -> Declaration:
        d = json.loads(text)
        return cls(d["kind"], d.get("options", {}))

    @property
    def key(self) -> str:
        return hashlib.sha1(self.to_json().encode()).hexdigest()


def crawl_once(graph: Csr, declaration: Declaration, seed: int, budget: int, rng_seed: int, run_id: str = "") -> pd.DataFrame:
    """The log of one run: BUDGET nodes at most, fewer if nothing is left. Equal declarations and seeds give equal logs."""
    state = Crawl(graph)
    rng = np.random.Generator(np.random.PCG64(rng_seed))
    policy = POLICIES[declaration.kind](state, rng, **declaration.options)
    v: int | None = int(np.searchsorted(graph.ids, seed))
    if v >= len(graph.ids) or graph.ids[v] != seed:
        raise ValueError(f"no node {seed}")
    state.observe(v)
    rows = []
    while v is not None and len(rows) < budget:
        new = state.crawl(v)
        y = int(graph.y[v])
        rows.append((run_id, len(rows) + 1, int(graph.ids[v]), None if y < 0 else y, policy.score if rows else None, len(state.observed), len(new), [float(w) for w in policy.weights]))
        policy.after(v, new)
        v = policy.next() if len(rows) < budget else None
    return pd.DataFrame(rows, columns=["run_id", "step", "node", "y", "score", "n_observed", "n_new", "weights"])


def collect_graph(edges: DataFrame, labels: DataFrame | None = None, max_edges: int = MAX_EDGES) -> Csr:
    """A graph as arrays on the driver, if it has no more than max_edges edges (16 bytes each)."""
    if edges.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges: cut the graph (graph.hops to the budget, graph.induced) or crawl by joins (crawl_levels)")
    e = edges.select("src", "dst").toPandas()
    y = None
    if labels is not None:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        own = labels.where(F.col("y").isNotNull()).join(ends, "id", "left_semi").toPandas()
        y = dict(zip(own["id"].astype(int), own["y"].astype(int)))
    return Csr.build(e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64), y)


def crawl(runs: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The crawl log (LOG) of runs (run_id, declaration JSON, seed, budget, rng_seed) over one graph.

    A crawl is sequential, so a run is one task's work and runs are parallel. The graph is broadcast after its size is checked.
    """
    spark: SparkSession = runs.sparkSession
    sent = spark.sparkContext.broadcast(collect_graph(edges, labels))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        return crawl_once(sent.value, Declaration.from_json(r["declaration"]), int(r["seed"]), int(r["budget"]), int(r["rng_seed"]), r["run_id"])

    return runs.groupBy("run_id").applyInPandas(one, LOG)


def crawl_levels(edges: DataFrame, seeds: DataFrame, budget: int) -> DataFrame:
    """Rows (seed, step, node): breadth-first order by levels and then ids, by joins alone, for graphs of any size."""
    from pyspark.sql.window import Window

    from gleaner.operators.graph import hops

    seen = hops(edges, seeds, enough=budget)
    w = Window.partitionBy("source").orderBy("hop", "id")
    return seen.select(F.col("source").alias("seed"), F.row_number().over(w).alias("step"), F.col("id").alias("node")).where(F.col("step") <= budget)


def plan_runs(spark: SparkSession, declarations: dict[str, Declaration], seeds: list[int], budget: int) -> DataFrame:
    """A run for each declaration and seed; rng seeds are hashed from both."""
    rows = [
        (f"{name}-{i}", d.to_json(), s, budget, int(hashlib.sha1(f"{d.key}:{i}".encode()).hexdigest()[:8], 16)) for name, d in declarations.items() for i, s in enumerate(seeds)
    ]
    return spark.createDataFrame(rows, "run_id string, declaration string, seed long, budget int, rng_seed long")


#: The standard crawlers.
PRESETS = {
    "random": Declaration("random"), "walk": Declaration("walk"), "bfs": Declaration("bfs"), "dfs": Declaration("dfs"), "snowball": Declaration("snowball", {"p": 0.5}),
    "mod": Declaration("mod"), "pod": Declaration("pod"), "med": Declaration("med"), "mrd": Declaration("mrd"),
    "mtn": Declaration("predicted", {"predictors": [{"kind": "mtn"}]}),
    "knn": Declaration("predicted", {"predictors": [{"kind": "knn", "k": 30}], "rescore": "after_train"}),
    "boosted": Declaration("predicted", {"predictors": [{"kind": "boosted"}], "rescore": "after_train", "train": {"kind": "boosting"}}),
    "forest": Declaration("predicted", {"predictors": [{"kind": "forest"}], "rescore": "after_train"}),
    "kernel": Declaration("predicted", {"predictors": [{"kind": "logistic", "kernel": True}], "rescore": "after_train"}),
    "sage": Declaration("predicted", {"predictors": [{"kind": "sage"}], "rescore": "after_train"}),
    "average": Declaration("predicted", {"predictors": [{"kind": "mtn"}, {"kind": "logistic"}], "combine": "average"}),
    "exponential": Declaration("predicted", {"predictors": [{"kind": "mtn"}, {"kind": "logistic"}], "combine": "exponential"}),
    "leader": Declaration("predicted", {"predictors": [{"kind": "mtn"}, {"kind": "logistic"}], "combine": "leader"}),
    "thompson": Declaration("predicted", {"predictors": [{"kind": "mtn"}, {"kind": "logistic"}], "combine": "thompson"}),
}
