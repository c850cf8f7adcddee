"""The pipeline on a small table: each stage's decisions, and stages that follow each other."""

import importlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, lang, n):
    parts = {"aa": ["the", "shing", "ough", "wh"], "bb": ["eau", "ille", "que", "oi"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(n))


def make():
    rng = random.Random(9)
    rows, shared = [], text(rng, "aa", 25)
    for i in range(60):
        lang = "aa" if i % 3 else "bb"
        t = text(rng, lang, 60)
        if i % 10 == 5:
            t += " " + shared
        rows.append((i, t, lang, "hot" if i % 4 else "cold"))
    rows.append((100, rows[7][1], "aa", "hot"))
    rows.append((101, rows[8][1] + " more", "aa", "cold"))
    rows += [(102, "", "aa", "hot"), (103, None, None, None), (104, "12 34 ---", None, "hot")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def test_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    rows = make()
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(pipeline.STAGES)
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) in (4, 5)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())

    one = stages[names[0]](spark, docs, "").cache()
    assert one.columns == docs.columns and ids(one) == sorted(set(range(60)) | {100, 101})
    two = stages[names[1]](spark, one, "").cache()
    assert two.columns == docs.columns and ids(two) == list(range(60))
    three = stages[names[2]](spark, two, "").cache()
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    seen = set()
    for r in sorted(three.collect(), key=lambda r: r["doc_id"]):
        b = texts[r["doc_id"]].encode()
        own = [b[i : i + 50] for i in range(len(b) - 49)]
        gone = bytearray(len(b))
        for i, s in enumerate(own):
            if s in seen:
                gone[i : i + 50] = b"\1" * 50
        assert r["text"] == bytes(x for x, g in zip(b, gone) if not g).decode()
        assert r["n_chars"] == len(r["text"])
        seen.update(own)
    assert sum(len(r["text"]) for r in three.collect()) < sum(map(len, texts.values()))
    four = stages[names[3]](spark, three, "").cache()
    assert four.columns == docs.columns and set(ids(four)) == set(range(60))
    share = {r["source"]: r["n"] for r in four.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert share["cold"] > 15  # the smaller source is read more than once
    five = stages[names[4]](spark, four, "")
    assert five.where("not round_trip").count() == 0 and five.count() == four.count()


def test_run(spark, data):
    pipeline = importlib.import_module("corpus_pipeline")
    assert pipeline.run(spark, data).count() > 50


def test_empty(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_odd_rows(spark):
    """Null and repeated ids, null and empty texts and a text beyond a chunk go through every stage."""
    pipeline = importlib.import_module("corpus_pipeline")
    rng = random.Random(4)
    plain = [text(rng, "aa", 60) for _ in range(30)]
    words = [text(rng, "aa", 1) for _ in range(4000)]
    long_one = " ".join(rng.choice(words) for _ in range(260_000))
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate(plain)] + [(None, plain[3] + " x", None, None, None), (None, text(rng, "aa", 60), None, None, None), (5, text(rng, "aa", 60), "aa", "t", 1)]
    rows += [(5, plain[7] + " y", "aa", "t", 1), (40, long_one, "aa", "s", 1), (41, long_one + " z", "aa", "s", 1), (42, None, None, None, None), (43, "", "aa", "s", 0)]
    assert len(long_one.encode()) > 2 << 20
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    first = [(r[0], r[1]) for r in rows if r[1]]
    assert kept["language_id"] == sorted(first, key=str) and docs.where("lang is null").count() == 0
    gone = {plain[3] + " x", plain[7], long_one + " z"}  # 5 is the smaller id
    assert kept["near_duplicates"] == sorted((r for r in first if r[1] not in gone), key=str)
    assert {i for i, _ in kept["mix_sources"]} == {i for i, _ in kept["near_duplicates"]}
    last = pipeline.STAGES[-1][1](spark, docs, "")
    assert last.where("not round_trip or not parity").count() == 0 and last.count() == docs.count()
