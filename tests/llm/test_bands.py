"""Perplexity bands against bands drawn plainly, over texts without letters and many languages."""

import math
import random

import pytest

from gleaner.llm import quality


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "ün", "é"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def middle(values):
    """The smallest value that half of all values don't exceed."""
    values = sorted(values)
    return values[math.ceil(len(values) / 2) - 1]


def plain(rows):
    """(lower, upper, kept) for each row, by the bands of all rows of its language."""
    out = {}
    for name in {r["model"] for r in rows}:
        own = [r for r in rows if r["model"] == name]
        steps = [(math.floor(min(r["log_ppl"], quality.PERPLEXITY_TOP) / quality.PERPLEXITY_STEP) + 0.5) * quality.PERPLEXITY_STEP for r in own if r["log_ppl"] is not None]
        for r in own:
            lower = upper = None
            if steps:
                median = middle(steps)
                spread = max(1.4826 * middle([abs(x - median) for x in steps]), quality.PERPLEXITY_STEP)
                width = quality.BAND * spread + quality.BAND_SHORT / math.sqrt(max(r["n_bytes"], 1))
                lower, upper = median - width, median + width
            failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
            out[r["doc_id"]] = (lower, upper, not failed and r["log_ppl"] is not None and lower <= r["log_ppl"] <= upper)
    return out


def compare(df):
    model = quality.train(df)
    rows = [r.asDict() for r in quality.measure(df, model).collect()]
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, (lower, upper, kept) in want.items():
        assert (got[i]["lower"], got[i]["upper"]) == (pytest.approx(lower), pytest.approx(upper)), i
        assert got[i]["kept"] == kept, i
    return got


def test_kept_is_what_plain_bands_keep(spark):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(8, 80)) for _ in range(120)] + ["".join(rng.choice("qxzj7# ") for _ in range(300)) for _ in range(20)] + ["", None, "...", "same words here " * 9]
    rows = [(i, t, rng.choice(["xx", "yy", None])) for i, t in enumerate(texts)] + [(1000, None, "empty"), (1001, "", "empty"), (1002, sentence(rng, 30), "alone")]
    got = compare(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    assert got[1002]["kept"] and not got[1000]["kept"] and got[1000]["lower"] is None
    assert 60 < sum(r["kept"] for r in got.values()) < 130


def test_megabytes_without_letters(spark):
    """Log perplexities a letter without a bound neither fail nor move the bands of ordinary texts."""
    rng = random.Random(5)
    plain_texts = [sentence(rng, 60) for _ in range(40)]
    signs = "".join(rng.choice("#$%&*+-/<=>|~ ") for _ in range(6_000_000))
    rows = [(i, t, "xx") for i, t in enumerate(plain_texts)] + [(100, signs, "xx"), (101, signs[:2_500_000] + "a" + signs[2_500_000:5_000_000], "xx"), (102, signs[:3000], "xx"), (103, signs, "only")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert not any(got[i]["kept"] for i in (100, 101, 102)) and got[100]["log_ppl"] > 1e6
    assert all(got[i]["kept"] for i in range(40))
    assert got[103]["upper"] < 100  # what lies beyond the top counts as the top


@pytest.mark.parametrize("most", [quality.MOST_BROADCAST, 10])
def test_many_languages(spark, monkeypatch, most):
    """Bands are drawn on the executors, and joined where they are too many to broadcast; clashing names don't matter."""
    monkeypatch.setattr(quality, "MOST_BROADCAST", most)
    rng = random.Random(6)
    rows = [(3 * i + j, sentence(rng, 14), f"l{i:04}") for i in range(400) for j in range(2)] + [(9000 + i, sentence(rng, 30), "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'z' AS model", "'z' AS median", "'z' AS n", "'z' AS step", "'z' AS key")
    assert sum(r["kept"] for r in compare(df).values()) > 900
