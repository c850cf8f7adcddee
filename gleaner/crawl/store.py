"""A store of result curves, and a command that crawls a graph file."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.crawl import evaluation as ev
from gleaner.crawl import run as crawl

KEYS = ["graph", "crawler", "metric", "budget"]


def save(history: DataFrame, path: str) -> None:
    """Append curves (graph, crawler, metric, budget, instance, step, value), partitioned by graph; curves without any value are left out."""
    real = history.where("value is not null").select(*KEYS, "instance").distinct()
    history.join(real, [*KEYS, "instance"], "left_semi").write.mode("append").partitionBy("graph").parquet(path)


def read(spark: SparkSession, path: str, x_from: int | None = None, x_to: int | None = None) -> DataFrame:
    h = spark.read.parquet(path)
    if x_from is not None:
        h = h.where(F.col("step") >= x_from)
    return h if x_to is None else h.where(F.col("step") <= x_to)


def curves(log: DataFrame, labels: DataFrame, graph: str, budget: int) -> DataFrame:
    """Recall curves of a crawl log (run ids are crawler-instance) on the steps of exponential_steps, step 0 included."""
    total = labels.agg(F.sum(F.coalesce("y", F.lit(0))).alias("t"))
    found = ev.found_by_step(log, labels).where(F.col("step").isin(ev.exponential_steps(budget)))
    scored = ev.scores(found.crossJoin(F.broadcast(total)), F.col("t"))
    zero = log.select("run_id").distinct().select("run_id", F.lit(0).alias("step"), F.lit(0.0).alias("recall"))
    rows = scored.select("run_id", "step", "recall").unionByName(zero)
    run = F.regexp_extract("run_id", r"^(.*)-(\d+)$", 1), F.regexp_extract("run_id", r"^(.*)-(\d+)$", 2).cast("int")
    return rows.select(F.lit(graph).alias("graph"), run[0].alias("crawler"), F.lit("recall").alias("metric"), F.lit(budget).alias("budget"), run[1].alias("instance"), "step", F.col("recall").alias("value"))


def seeds(edges: DataFrame, n: int, seed: int, targets: DataFrame | None = None) -> list[int]:
    """n start nodes, drawn by a hash from all nodes or from targets(id)."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    if targets is not None:
        nodes = nodes.join(targets.select("id"), "id", "left_semi")
    return [r["id"] for r in nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).collect()]


def run_missing(spark: SparkSession, name: str, edges: DataFrame, labels: DataFrame, crawlers: list[str], instances: int, budget: int, path: str) -> DataFrame:
    """Crawl what the store lacks and append it; returns the store's curves of this graph."""
    try:
        have = read(spark, path).where((F.col("graph") == name) & (F.col("budget") == budget)).groupBy("crawler").agg(F.countDistinct("instance").alias("n"))
        done = {r["crawler"]: r["n"] for r in have.collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = {}
    starts = seeds(edges, instances, 1)
    runs = None
    for c in crawlers:
        own = crawl.plan_runs(spark, {c: crawl.PRESETS[c]}, starts, budget).where(F.regexp_extract("run_id", r"-(\d+)$", 1).cast("int") >= done.get(c, 0))
        runs = own if runs is None else runs.unionByName(own)
    if runs is not None and not runs.isEmpty():
        save(curves(crawl.crawl(runs, edges, labels), labels, name, budget), path)
    return read(spark, path).where((F.col("graph") == name) & (F.col("budget") == budget))


def main(args: list[str] | None = None) -> None:
    """Crawl an edge-list file: targets are the nodes whose attribute has a value; prints mean recall, area and last value a crawler."""
    from gleaner.operators import features as ft
    from gleaner.operators import graph as g
    from gleaner.session import session
    from gleaner.sources import files

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("graph", help="edge list")
    p.add_argument("attribute", help="JSON file {node: value}")
    p.add_argument("value", help="target value")
    p.add_argument("-c", "--crawlers", nargs="+", choices=sorted(crawl.PRESETS), default=["mod", "mtn"])
    p.add_argument("-n", "--instances", type=int, default=8)
    p.add_argument("-b", "--budget", type=int, default=100)
    p.add_argument("-o", "--out", required=True, help="folder of the result store")
    a = p.parse_args(args)
    spark = session()
    edges = files.edge_list(spark, a.graph)
    nodes = g.nodes_of(edges).join(files.attribute(spark, a.attribute), "id", "left")
    labels = ft.attribute_oracle(nodes.withColumn("value", F.regexp_replace("value", '^"|"$', "")), "value", a.value)
    found = run_missing(spark, a.graph, edges, labels, a.crawlers, a.instances, a.budget, a.out)
    ev.aggregated(ev.curve_measures(found, [*KEYS, "instance"]), KEYS, "tc").show(100, False)


if __name__ == "__main__":
    main()
