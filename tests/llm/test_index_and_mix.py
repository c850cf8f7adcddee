"""The index compacts within the registered query; a mix whose columns clash with the operator's own, and one whose schedule isn't broadcast."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing, queries, substrings


def test_the_query_compacts(spark, data, monkeypatch):
    """Four batches with the query's own settings: the first two runs become one, and the result is that of one batch."""
    merged, whole = [], substrings.FingerprintIndex.compact

    def compact(self, last=None):
        before = len(self.runs)
        whole(self, last)
        merged.append((before, list(self.levels)))

    monkeypatch.setattr(substrings.FingerprintIndex, "compact", compact)
    got = {r.doc_id: tuple(r) for r in queries.op9_substring_dedup(spark, data).collect()}
    assert merged == [(2, [1])]
    monkeypatch.setattr(substrings, "FAN", 100)
    plain = {r.doc_id: tuple(r) for r in substrings.dedup(spark.read.parquet(f"{data}/documents.parquet"), batches=1, keep_text=False).collect()}
    assert got == plain and len(merged) == 1 and sum(r[2] for r in got.values()) > 0


def test_levels_of_many_batches(spark, tmp_path, monkeypatch):
    """Runs of one level are merged as batches come in, over calls too, and no window is lost."""
    rng = random.Random(2)
    shared = [" ".join(f"w{rng.randrange(50)}" for _ in range(16)) for _ in range(6)]
    docs = [(i, f"a{i} " + rng.choice(shared) + f" b{i}") for i in range(42)]
    path = f"file://{tmp_path}/index"
    found, levels = {}, []
    for a in range(0, 42, 6):
        part = spark.createDataFrame(docs[a : a + 6], "doc_id long, text string")
        found |= {r.doc_id: r.n_removed for r in substrings.dedup(part, batches=1, keep_text=False, index=path).collect()}
        levels.append(substrings.FingerprintIndex.open(spark, path).levels)
    assert levels == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0], [2, 0, 0], [2, 1, 0]]
    want = {r.doc_id: r.n_removed for r in substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"), batches=1, keep_text=False).collect()}
    assert found == want and sum(want.values()) > 400


@pytest.mark.parametrize("most", [mixing.BROADCAST_ROWS, 0])
def test_mix_with_clashing_columns(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    rows = [(rng.choice([None, i, i]), "word " * rng.randint(0, 9), "hot" if i % 10 else rng.choice(["a", "b", None])) for i in range(400)] + [(7, "word", "a")] * 3 + [(8, None, "b"), (9, "", None)]
    names = ["at", "epoch", "place", "__mark", "__s", "__b", "block", "weight", "with.dot", "__source", "__block"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(names)))
    target = mixing.Target(entropy=0.97, repetition=1.5)
    mixed = mixing.realise(df, target)
    assert mixed.columns == df.columns
    got = Counter(tuple(r)[:3] for r in mixed.collect())
    assert {tuple(r)[3:] for r in mixed.collect()} == {tuple(f"x{i}" for i in range(len(names)))}
    reads = mixing.weigh(df, target).where("epoch IS NOT NULL").groupBy("doc_id", "source").count().collect()
    want, copies = {(r.doc_id, r.source): r["count"] for r in reads}, Counter((k, s) for k, _, s in got.elements())
    assert copies == Counter(want)
    assert set(got) <= set(rows) and all(got[x] >= n for x, n in Counter(rows).items() if x[1] and x[0] is not None)
    assert mixing.realise(df.limit(0), target).count() == 0
