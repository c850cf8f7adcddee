"""Graph views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import graph as g
from gleaner.operators.table import dealt, tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """Parts bought in the same order, in `least` rows pairs at least: (src, dst), src < dst.

    Lines are counted by (order, part) first, so what is joined has a row a part of an order. Orders and pairs are dealt to tasks by the number of lines.
    """
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = tasks(spark, rows.count())
    lines = rows.repartition(n, "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    a, b = lines.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("n").alias("n1")), lines.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("n").alias("n2"))
    met = a.join(b, "l_orderkey").where("src < dst").select("src", "dst", (F.col("n1") * F.col("n2")).alias("n"))
    pairs = met.repartition(2 * n, "src", "dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return pairs.where(F.col("n") >= least).select("src", "dst")


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed bipartite arcs supplier -> part; suppliers have even ids 2k, parts odd ones 2k + 1."""
    return dealt(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")), "src", "dst").distinct()


def part_labels(spark: SparkSession, sf_dir: str, kind: str = "ECONOMY") -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_type") == kind).cast("int").alias("y"))


def crawled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a crawl's state: every third part."""
    return table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))


def customer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph of customers for iterations: i is linked with i // 2 and, every third one, with i + 7."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))
    top = c.agg(F.max("i").alias("top"))
    half = c.where("i > 3 and i % 5 <> 0").select(F.col("i").alias("a"), F.floor(F.col("i") / 2).alias("b"))
    seven = c.where("i % 3 = 0").crossJoin(F.broadcast(top)).where("i + 7 <= top").select(F.col("i").alias("a"), (F.col("i") + 7).alias("b"))
    return g.edges_from(half.unionByName(seven), "a", "b")


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as moves: from user_id to the user that props names, lasting an hour."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source"), (F.get_json_object("props", "$.k").cast("long") % 150).alias("target"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"),
    )


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic result curves out of orders: graph, crawler, instance, step, value."""
    o = table(spark, sf_dir, "orders")
    h = o.select(
        F.concat(F.lit("g"), (F.col("o_custkey") % 5).cast("string")).alias("graph"), F.concat(F.lit("c"), (F.col("o_orderkey") % 4).cast("string")).alias("crawler"),
        (F.col("o_custkey") % 3).cast("int").alias("instance"), ((F.col("o_orderkey") % 17) * 3 + 1).cast("int").alias("step"), F.col("o_totalprice").alias("v"),
    )
    return h.groupBy("graph", "crawler", "instance", "step").agg(F.max("v").alias("value"))
