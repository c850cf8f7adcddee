"""Packing against brute force: ids, the optimum of small instances, and gapless sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing

FILE = public_tokenizers.path("word_bpe_49k.json")
#: Names that the operator uses itself; they must not get in its way.
SCHEMA = "doc_id long, text string, key string, piece string, start string, length string, __row string, __number string, sequence_id string"


def optimum(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            left = list(rooms)
            left.remove(room)
            go(i + 1, [*left, room - items[i]])
        go(i + 1, [*rooms, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def instances(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        c = rng.choice([10, 20, 30, 100])
        low = max(1, rng.choice([1, c // 5, c // 4, c // 3]))
        yield c, [rng.randint(low, c) for _ in range(rng.randint(0, 9))]


def test_reduction_keeps_the_optimum():
    fixed = 0
    for c, items in instances(1, 1500):
        made = packing.Plan(Counter(items), c)
        made.reduce()
        left = [s for s, n in made.left.items() for _ in range(n)]
        assert made.fixed + optimum(left, c) == optimum(items, c), (c, items)
        fixed += made.fixed
    assert fixed > 2000


def test_plan_puts_each_piece_once_without_gaps():
    for c, items in instances(2, 800):
        made, sequences, ranks = packing.plan(Counter(items), c), defaultdict(list), defaultdict(list)
        for s, first, last, sequence, per, offset in made.rows:
            ranks[s] += range(first, last)
            for k in range(last - first):
                sequences[sequence + k // per].append((offset + k % per * s, s))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in Counter(items).items()}
        assert sorted(sequences) == list(range(made.sequences))
        for own in sequences.values():
            at = 0
            for offset, s in sorted(own):
                assert offset == at
                at += s
            assert at <= c
        assert packing.lower_bound(Counter(items), c) <= optimum(items, c) <= made.sequences <= 11 * optimum(items, c) / 9 + 1


def test_large_histograms_near_the_bound():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 4097, 200_000), rng.integers(1000, 4097, 200_000), np.minimum(rng.lognormal(5.5, 1.2, 200_000).astype(int) + 1, 4096), np.full(200_000, 1365), np.full(1000, 4096)):
        count = Counter(lengths.tolist())
        made = packing.plan(count)
        assert made.sequences <= 1.002 * packing.lower_bound(count) + 1
        assert len(made.rows) < 50_000  # what is broadcast hangs on the capacity, not on the rows


def texts():
    rng = random.Random(5)
    words = ["we'll", "don't", "Straße", "ΑΣ", "ÉTÉ", "éa", "́x", "12,5", "漢字", "...", "<|endoftext|>", "a<|startoftext|>b", "x" * 300, " ", "\x1c", "\x00", "naïve", "a|b", "|", "||", "~|x", "ﬁ", "İ", "'S", "👩‍👩‍👧", " z"]
    out = [" ".join(rng.choice(words) + rng.choice(["", ".", "s"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    out += ["", None, " \n\t ", "\x0b\x0c", "one", "one", "y" * 400_000, "\n".join("line " * 9 for _ in range(2000)), ("the " * 4095).strip(), ("the " * 4096).strip(), "漢字" * 800_000 + " end", "ab " * 1_000_000]
    return out


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text.encode()), "<u4").tolist()


def test_words_apart_give_the_ids_of_whole_texts():
    own, whole = packing.WordEncoder(open(FILE).read()), Tokenizer.from_file(FILE)
    for t in texts():
        if t is not None and len(t) < 500_000:
            assert ids(own, t) == whole.encode(t, add_special_tokens=False).ids, t[:80]
    packing.REMEMBERED, kept = 1000, packing.REMEMBERED  # forgets between slices
    try:
        for t in texts()[:20]:
            assert ids(own, t) == whole.encode(t, add_special_tokens=False).ids
    finally:
        packing.REMEMBERED = kept
    with pytest.raises(ValueError):
        packing.WordEncoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())


def check(found, docs, capacity, n_sequences=None):
    whole = Tokenizer.from_file(FILE)
    ids = Counter()
    for key, t in docs:
        own = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(own), capacity):
            cut = np.array(own[a : a + capacity], "<u4")
            ids[key, a // capacity, a, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert ids == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = Counter(r.length for r in found)
    assert len(sequences) <= packing.lower_bound(lengths, capacity) + 1
    return sequences


def test_pack(spark):
    docs = [(i, t) for i, t in enumerate(texts())] + [(None, "one"), (None, None), (3, "one"), (3, "one")]
    made = packing.pack(spark.createDataFrame([(*d, *["z"] * 7) for d in docs], SCHEMA).repartition(6), FILE, keep_ids=True)
    found = made.collect()
    check(found, docs, packing.CAPACITY)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found)
    small = packing.pack(spark.createDataFrame(docs[:60], "doc_id long, text string"), FILE, capacity=64, keep_ids=False)
    check(small.collect(), docs[:60], 64)
    assert "ids" not in small.columns


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_driver_documents(spark, data):
    from gleaner.llm.queries import op13_best_fit_packing

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    check(op13_best_fit_packing(spark, data).collect(), docs, 4096)
