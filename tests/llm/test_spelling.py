"""Spelling variants against plain Python: all pairs of words compared, chains followed one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from gleaner.llm import spelling

#: Names that the operator uses itself; they must not get in its way.
SCHEMA = "doc_id long, text string, key string, word string, run string, h string, at string, n string, size string, `group` string, low string"


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_vocabulary(docs, slip_every):
    count = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip_every and h % slip_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def plain_group(words):
    near = {w: [x for x in words if is_near(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]])
    return out


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def mutated(rng, w, letters):
    i = rng.randrange(len(w) + 1)
    kind = rng.randrange(3)
    return w[:i] + rng.choice(letters) + w[i + (kind == 0) :] if kind < 2 else w[:i] + w[i + 1 :]


def vocabulary(rng, letters, n):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(n // 4)]
    words = set(base)
    while len(words) < n:
        words.add(mutated(rng, rng.choice(base + list(words)[:50]), letters))
    return {w: rng.choice([5, 7, 30, 200, 1200, 9000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("pairs, letters", [(spelling.PAIRS, "abcdéß"), (9, "ab"), (1, "abcÿ")])
def test_group_equals_all_pairs(spark, monkeypatch, pairs, letters):
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    monkeypatch.setattr(spelling, "SHARD_ROWS", 100)
    words = vocabulary(random.Random(pairs), letters, 400)
    words |= {"aaaaaa": 5, "aaaaaaa": 5, "aaaaaaaa": 30, "b" * 300: 5, "b" * 299: 5, "b" * 150 + "a" + "b" * 149: 40}
    assert got(spelling.group(spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n long, size string").repartition(5))) == plain_group(words)


def test_a_half_of_a_third_of_all_words_is_split(spark):
    """Words with one beginning: groups stay below the bound by halves of halves, and no pair is lost."""
    rng = random.Random(4)
    words = {"begin" + "".join(rng.choice("abcdefgh") for _ in range(5)): rng.choice([5, 60, 700]) for _ in range(1500)}
    words |= {"".join(rng.choice("klmnopqr") for _ in range(10)): 5 for _ in range(1500)}
    rows = spelling.segments(spark.createDataFrame(list(words.items()), "word string, n long"))
    sizes = rows.groupBy("group").count().agg({"count": "max"}).first()[0]
    assert sizes <= 600 and rows.count() < 20 * len(words)
    assert got(spelling.group(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain_group(words)


def test_variants_of_documents(spark):
    rng = random.Random(8)
    bag = list(vocabulary(rng, "abÀéÿ", 60)) + ["×÷×÷×÷", "ÉCOLES", "écoles", "Straße", "ſtraße", "KELVIN", "kelvin", "shortt", "short"]
    docs = [(i, " ".join(rng.choice(bag) + rng.choice([" ", ",", "-", "1", "Ā", "́", "\x00", "\n"]) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    docs += [(None, docs[0][1]), (None, None), (7, None), (7, ""), (3, docs[3][1]), (3, docs[3][1]), (900, "repeated " * 200_000 + "x" * 2_000_000), (-5, docs[5][1].upper())]
    df = spark.createDataFrame([(*d, *["z"] * 9) for d in docs], SCHEMA).repartition(4)
    for slip in (None, 3):
        words = plain_vocabulary(docs, slip)
        assert len(words) > 40
        assert {r.word: r.n for r in spelling.vocabulary(df, slip_every=slip).collect()} == words
        assert got(spelling.variants(df, slip_every=slip)) == plain_group(words)


def test_chains(spark):
    words = {"abcdefg": 5, "abcdefgh": 25, "abcdefghi": 125, "abcdefghij": 625, "abcdefghijk": 3125, "abcdefghijkl": 15625, "zbcdefg": 25, "Zbcdefg": 25}
    found = got(spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found == plain_group(words)
    assert found["abcdefg"][:2] == ("Zbcdefg", "Zbcdefg") and found["abcdefgh"][1] == "abcdefghijkl"  # of two as frequent, the smaller


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(none).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "word")], "doc_id long, text string")).count() == 0


def test_driver_documents(spark, data):
    from gleaner.llm.queries import op12_spelling_variants

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert got(op12_spelling_variants(spark, data)) == plain_group(plain_vocabulary(docs, 199))
