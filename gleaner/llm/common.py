"""What all operators share: tables, hash-range parts, folds, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import graph
from gleaner.operators.table import join_counted
from gleaner.session import discard, free_shuffles, materialize, materialize_counted, shared_folder

__all__ = [
    "bound_batches", "components", "discard", "free_shuffles", "held_out", "input_bytes", "join_counted", "materialize", "materialize_counted", "parts", "reached", "shared_folder", "table",
]

#: Texts go to Python in Arrow batches of at most this many bytes and rows.
ARROW_BYTES = 4 << 20
ARROW_ROWS = 2000
#: Bytes of files for each hash range, so that what a task holds doesn't grow with the input, whatever the session's settings.
PART_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; read by Spark alone, so any store will do."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, as a Python worker holds a few copies of one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def input_bytes(df: DataFrame) -> int:
    """What Spark expects df to read (the size of its files); 0 if it can't tell."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def parts(df: DataFrame) -> int:
    """Hash ranges for binary-packed keys of df: one for each PART_BYTES of its files, and the session's shuffle partitions at least."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // PART_BYTES))


def shard_of(text_id: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(text_id.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32(doc_id as text) mod 5 = 0."""
    return shard_of(doc_id) % 5 == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), both bigint: rows (id, component), the smallest id that each one reaches; nodes without an edge aren't returned."""
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def reached(rows: DataFrame, total: int, found: DataFrame) -> DataFrame:
    """rows (node, rep, key, ...), `total` of them, with component_id and first_node; found: components (id, component) of reps.

    first_node is the component, or the rep where it has none; component_id the smallest key of all rows with that first_node; a key that is null counts only if all are.
    """
    base = rows.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("first_node", F.coalesce("component", "rep")).drop("component")
    least = base.groupBy("first_node").agg(F.min("key").alias("component_id"), F.count("*").alias("n"))
    return join_counted(base, least, "first_node", total, "node")
