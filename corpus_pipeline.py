"""A corpus pipeline: language ID, near-duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the next
one; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import jaccard, language, mixing, pieces, suffixes
from gleaner.llm.common import bound_batches, held_out, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents whose language is less certain go.
LEAST_SCORE = 0.4
MIX = mixing.Target(entropy=0.97, repetition=1.5)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language is uncertain; a null lang becomes the predicted one.

    Null and empty texts have no letters. Repeated rows and null ids are judged like any others; a text of any length is read whole.
    """
    bound_batches(spark)
    model = language.learn(docs.where(~held_out(F.col("doc_id"))))
    found = language.predict(docs, model, spans=False, carry=COLUMNS)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*((F.coalesce("row.lang", "lang_pred") if c == "lang" else F.col(f"row.{c}")).alias(c) for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates, nulls last.

    Texts without words stay. Rows with one id, or null, are rows of their own; of those with equal texts one stays at most.
    """
    bound_batches(spark)
    return jaccard.keep_one(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document with a smaller doc_id holds; a document of which nothing is left goes.

    Null ids come after all others; rows with equal ids, or null, don't cut each other. A null text becomes an empty one.
    """
    bound_batches(spark)
    cut = suffixes.dedup(docs, carry=["lang", "source", "n_chars"]).where("n_removed = 0 or trim(kept_text) <> ''")
    text = F.col("kept_text")
    size = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return cut.select("doc_id", text.alias("text"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), size.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Read sources by their target weights; every document is read once at least. A null source is one of its own."""
    bound_batches(spark)
    return mixing.realise(docs.select(*COLUMNS), MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; null and empty texts have none, null and repeated ids stay."""
    bound_batches(spark)
    return pieces.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL can't express most of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir; stages are handed on as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
