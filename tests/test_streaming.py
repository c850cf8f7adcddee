"""Streams end with the rows that a batch gives."""

from pyspark.sql import functions as F

from gleaner.crawl import run as crawl
from gleaner.plans.views import customer_graph, table
from gleaner.streaming import events as se


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windowed_counts(spark, data, tmp_path):
    table(spark, data, "events").repartition(3).write.parquet(str(tmp_path / "in"))
    got = drain(se.windowed_counts(se.read_events(spark, str(tmp_path / "in"), 10)), "counts", "complete", tmp_path)
    want = table(spark, data, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").count()
    assert {(r["start"], r["event_type"]): r["events"] for r in got.collect()} == {(r["start"], r["event_type"]): r["count"] for r in want.collect()}


def test_crawl_by_ticks(spark, data, tmp_path):
    """Two ticks of 10 give the log of one run of 20."""
    edges = customer_graph(spark, data)
    d = crawl.PRESETS["mod"]
    ticks = "run_id string, declaration string, seed long, rng_seed long, budget int"
    for i in range(2):
        spark.createDataFrame([("r", d.to_json(), 6, 1, 10)], ticks).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))
    got = drain(se.crawl_ticks(stream, edges), "steps", "append", tmp_path)
    want = crawl.crawl_once(crawl.collect_graph(edges), d, 6, 20, 1)
    assert [r["node"] for r in got.orderBy("step").collect()] == want["node"].tolist()
