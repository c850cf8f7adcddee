"""The text operators against brute force, over tables with nulls, empty, long and repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import classifier, jaccard, language, mixing, pieces, quality, sharding, substrings, suffixes
from gleaner.llm import textkit as tk
from gleaner.llm.common import held_out

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Names that an operator might use for itself; they must not get in its way.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, chunk string, part string, tokens string, row string, batch string, label string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "ün", "é"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def make_rows():
    rng = random.Random(3)
    shared, long_one = sentence(rng, 30), sentence(rng, 4000)
    texts = [sentence(rng, rng.randint(20, 120)) for _ in range(40)]
    texts += [f"{sentence(rng, 20)} {shared} {sentence(rng, rng.randint(0, 9))}" for _ in range(12)]
    base = sentence(rng, 100).split()
    for i in range(12):
        w = list(base)
        w[i * 7 % 100] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0]] * 3 + [texts[1] + " tail"] + [long_one, long_one[:5000], "a " * 300, "x" * 400, "x" * 380]
    texts += ["", " \n\t ", None, "one", "One", "two words", "two  words", "漢字かな 漢字", "\x00nul\x00" * 20, "- 1 2 3 -", "\n".join(["same line here"] * 9), "é " * 60]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, texts[0]), (None, None), (5, texts[2])]
    return [(i, t, rng.choice(["l1", "l2", None]), rng.choice(["s", "s", "t", None]), None, "k", "n", "c", "p", "t", "r", "b", "l") for i, t in rows]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i):
    return (1, 0) if i is None else (0, i)


def as_bag(rows):
    return sorted(rows, key=lambda r: tuple(str(x) for x in r))


def test_suffix_dedup(docs, none):
    first = {}
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            k = b[a : a + 50]
            first[k] = min(first.get(k, (2, 0)), order(i))
    want = []
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < order(i):
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    got = suffixes.dedup(docs, carry=["source", "row"])
    plain = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert as_bag(map(tuple, plain.collect())) == as_bag(want)
    assert sum(w[2] for w in want) > 1000
    for r in got.collect():
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] and len(r["removed"]) == r["n_spans"]
        assert r["row"]["row"] == "r"
    assert suffixes.dedup(none).count() == 0


def test_substring_dedup(docs, none):
    first = {}
    for i, t, *_ in ROWS:
        w = WORD.findall(t or "")
        for a in range(len(w) - 12):
            k = tuple(w[a : a + 13])
            first[k] = min(first.get(k, (2, 0)), order(i))
    want = []
    for i, t, *_ in ROWS:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < order(i):
                gone[a : a + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for batches in (1, 4):
        got = substrings.dedup(docs, batches=batches)
        assert as_bag(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == as_bag(want)
        for r in got.collect():
            assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert sum(w[2] for w in want) > 200
    assert substrings.dedup(none).count() == 0


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join(docs, none):
    sets = [shingles(t) for _, t, *_ in ROWS]
    head = list(range(len(ROWS)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(ROWS)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                head[find(a)] = find(b)
    groups = {}
    for x in range(len(ROWS)):
        groups.setdefault(find(x), []).append(ROWS[x][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = [(ROWS[x][0], len(sets[x]), least[find(x)]) for x in range(len(ROWS))]
    got = jaccard.join(docs)
    assert as_bag(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == as_bag(want)
    assert jaccard.join(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert jaccard.keep_one(none).count() == 0


@pytest.mark.parametrize("many, few", [(8, 4096), (0, 4096), (0, 4)])
def test_jaccard_blocks(spark, monkeypatch, many, few):
    """Families beyond a block are compared in pairs of blocks, and large ones by pivots and pairs, with the same result."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "MANY", many)
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = random.Random(1)
    base = sentence(rng, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i // 6):
            w[(j * 5 + 1) % 60] = f"n{i // 6 * 10 + j}"
        rows.append((i, " ".join(w) + f" end{i % 6}"))
    sets = [shingles(t) for _, t in rows]
    label = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = min(label[a], label[b])
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(label))
    assert len(set(label)) > 1


def test_overlaps():
    """Dense and light columns of the product, against sets."""
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(100, 5000, 50)])).astype(np.uint64) for _ in range(120)]
    got = jaccard.overlaps(sets[:70], sets[60:])
    assert (got == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[60:]] for x in sets[:70]]).all()


def test_long_structured_words_are_told_apart(spark):
    """Words that arithmetic hashes confuse (Thue-Morse words) make different windows and shingles."""
    turn = lambda n, c: "".join(c[bin(i).count("1") & 1] for i in range(n))
    a, b = turn(2048, "ab"), turn(2048, "ba")
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([a, *words])), (2, " ".join([b, *words])), (3, " ".join([a] * 2 + [b] * 3)), (4, " ".join([b] * 2 + [a] * 3)), (5, " ".join([a, *words]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.dedup(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}  # 1 and 2 share 8 of 10 shingles
    both = [tk.spans(np.frombuffer((a + b).encode(), np.uint8), np.array([0, 2048]), np.array([2048, 4096]), f) for f in (0, 1)]
    assert both[0][0] != both[0][1] and both[1][0] != both[1][1]
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(df.withColumn("lang", F.lit("x"))).collect()}[3] == 0


def test_index_outlives_a_call(spark, docs, tmp_path, monkeypatch):
    """Documents dealt to two calls, and to a third one after compaction, lose what one call over all of them takes; earlier windows that nothing shared then count."""
    monkeypatch.setattr(substrings, "FAN", 3)
    plain = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(plain).collect()}
    got, path = {}, f"file://{tmp_path}/index"
    for lo, hi in ((0, 30), (30, 50), (50, 60), (60, 1000)):
        part = substrings.dedup(plain.where(f"doc_id >= {lo} and doc_id < {hi}"), batches=1, index=path)
        got |= {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in part.collect()}
    assert got == want and sum(w[0] for w in want.values()) > 200
    assert len(substrings.FingerprintIndex.open(spark, path).runs) < 4  # it was compacted
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("run_", "chunks_"))]


def test_texts_beyond_a_chunk(spark):
    """Texts larger than a slice and a chunk, of which one repeats most of another."""
    rng = random.Random(5)
    words = [sentence(rng, 1) for _ in range(3000)]
    one = " ".join(rng.choice(words) for _ in range(330_000))
    rows = [(1, one), (2, "start " + one[: 9 * len(one) // 10]), (3, "short text")]
    assert len(one.encode()) > 2 << 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: r for r in substrings.dedup(df, keep_text=False).collect()}
    n = len(rows[1][1].split())
    assert cut[1]["n_removed"] == 0 and n - 3 <= cut[2]["n_removed"] <= n - 1 and cut[1]["n_words"] == 330_000
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()} == {1: 1, 2: 1, 3: 3}
    gone = {r["doc_id"]: r for r in suffixes.dedup(df, keep_text=False).collect()}
    assert gone[1]["n_removed"] == 0 and gone[2]["n_bytes"] - gone[2]["n_removed"] < 60
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(df.withColumn("lang", F.lit("x"))).collect()} == {1: 330_000, 2: n, 3: 2}
    assert all(r["round_trip"] for r in pieces.encode(df, keep_ids=False).collect())


def test_quality_counts(docs, none):
    got = quality.judge(docs)
    want = []
    for i, t, *_ in ROWS:
        t = t or ""
        w = WORD.findall(t)
        seen = {}
        for a in range(len(w) - 4):
            seen.setdefault(tuple(w[a : a + 5]), []).append(a)
        hit = {a + j for at in seen.values() if len(at) > 1 for a in at for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert as_bag(map(tuple, got.select(*cols).collect())) == as_bag(want)
    assert got.where("base_failed and kept").count() == 0
    assert quality.judge(none).count() == 0


def test_perplexity_is_a_probability(spark):
    """For every context, the model's probabilities of all symbols sum to one; odd texts are rejected, plain ones kept."""
    rng = random.Random(4)
    texts = [sentence(rng, 60) for _ in range(80)]
    odd = ["".join(rng.choice("qxzj7#") for _ in range(8)) for _ in range(60)]
    rows = [(i, t, "xx") for i, t in enumerate(texts)] + [(99, " ".join(odd), "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.train(df)
    keys, _ = quality.grams(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0].encode())]))
    for key in keys[10:200:7]:
        every = (int(key) >> quality.BITS << quality.BITS) + np.arange(1 << quality.BITS)
        assert np.exp(model.log_prob(model.languages.index("xx"), every)).sum() == pytest.approx(1.0, abs=1e-6)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert not kept[99] and sum(kept.values()) == 80


def test_language_id(spark, docs, none):
    rng = random.Random(2)
    make = {"aa": ["the", "shing", "ough", "wh"], "bb": ["eau", "ille", "que", "oi"], "cc": ["мир", "на", "ого", "ет"]}
    text = lambda lang, n: " ".join("".join(rng.choice(make[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df.where(~held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    half = text("aa", 30) + " " + text("cc", 20) + " " + text("bb", 30)
    spans = language.predict(spark.createDataFrame([(1, half)], "doc_id long, text string"), model).first()["spans"]
    assert [s["lang"] for s in spans] == ["aa", "cc", "bb"] and spans[0]["start"] == 0 and spans[2]["end"] == len(half.encode())
    odd = language.predict(docs, model, carry=["row", "key"])
    assert odd.count() == len(ROWS)
    und = {i for i, t, *_ in ROWS if not any(c.isalpha() for c in t or "")} - {None}
    assert {r["doc_id"] for r in odd.where("lang_pred = 'und'").collect()} - {None} == und
    assert language.predict(none, model).count() == 0
    empty = language.learn(none)
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}


def test_viterbi_against_all_labellings():
    model = language.Model(["a", "b"], np.zeros((2, 1 << language.GRAM_BITS), np.float32), np.ones((len(language.SCRIPT_NAMES), 2), bool))
    rng = np.random.default_rng(0)
    model.log_share[:] = -rng.random(model.log_share.shape) * 6
    raw = np.frombuffer(b"ab cde f gh ijk lm n op qr st", np.uint8)
    scan = language.Scan(raw, np.array([0, len(raw)]))
    label, _ = language.label_words(model, scan, switch=3.0)
    w = scan.words
    score = np.array([[model.log_share[j][scan.gram[a:b]].sum() for j in range(2)] for a, b in zip(w.start, w.end)], float)
    total = lambda path: sum(score[t][s] for t, s in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))
    best = max(total([n >> t & 1 for t in range(len(score))]) for n in range(1 << len(score)))
    assert total(label.tolist()) == pytest.approx(best, abs=1e-6)


def test_classifier(spark, docs, none):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, " ".join(f"{w}***" for w in sentence(rng, 50).split()) if bad else sentence(rng, 50)))
        marks.append((i, int(not bad)))
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = classifier.classify(df, y, held_out).join(y, "doc_id").collect()
    assert len(got) == 300 and all((r["score"] >= 0.3) == (r["quality"] == 1) for r in got if r["held_out"])
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300)}
    odd = classifier.classify(docs, y, held_out).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    assert classifier.classify(none, y, held_out).count() == 0
    assert {r["score"] for r in classifier.classify(docs, y.limit(0), held_out).collect()} == {0.5}


def test_classifier_against_dense_algebra(spark):
    """Every score from a ridge solved in one piece and an isotonic fit by minima of maxima of means."""
    rng = random.Random(16)
    rows, marks = [], []
    for i in range(240):
        words = sentence(rng, 40).split()
        bad = rng.random() < 0.4
        rows.append((i, " ".join(w + "#" * (rng.random() < (0.3 if bad else 0.12)) for w in words)))
        marks.append((i, int(not bad)))
    rows += [(300, ""), (301, None), (302, rows[0][1])]
    df, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in classifier.classify(df, y, held_out).collect()}
    stats = {r["doc_id"]: np.array(r["stats"], float) for r in classifier.describe(df).collect()}
    later = {r["doc_id"] for r in df.where(F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(classifier.CALIBRATE)) == 0).collect()}
    mark = dict(marks)
    fit = [i for i in mark if zlib.crc32(str(i).encode()) % 5 and i not in later]
    after = [i for i in mark if zlib.crc32(str(i).encode()) % 5 and i in later]
    x = np.stack([stats[i] for i in fit])
    mean, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8))
    draw = np.random.Generator(np.random.PCG64(7))
    freq, phase = draw.normal(size=(x.shape[1], classifier.N_FOURIER)) / classifier.WIDTH, draw.uniform(0, 2 * np.pi, classifier.N_FOURIER)

    def features(z):
        z = np.clip((z - mean) / scale, -8, 8)
        return np.concatenate([np.sqrt(2 / classifier.N_FOURIER) * np.cos(z @ freq + phase), z / 8, np.ones((len(z), 1))], 1)

    f = features(x)
    coef = np.linalg.solve(f.T @ f / len(f) + classifier.RIDGE / f.shape[1] * np.eye(f.shape[1]), f.T @ np.array([mark[i] for i in fit]) / len(f))
    width = 3.0 / classifier.SCORE_BINS
    raw = {i: float((features(s[None]) @ coef)[0]) for i, s in stats.items()}
    bins = {}
    for i in after:
        bins.setdefault(int(min(max((raw[i] + 1) / width, 0), classifier.SCORE_BINS - 1)), []).append(mark[i])
    order_ = sorted(bins)
    ones, n = [sum(bins[b]) for b in order_], [len(bins[b]) for b in order_]
    level = [max(min(sum(ones[a : b + 1]) / sum(n[a : b + 1]) for b in range(k, len(n))) for a in range(k + 1)) for k in range(len(n))]
    edges = [-1 + (b + 0.5) * width for b in order_]
    for i, v in raw.items():
        assert got[i] == pytest.approx(float(np.interp(v, edges, level)), abs=1e-4), i
    assert len(set(level)) > 3 and got[300] == got[301] and got[302] == got[0]


def test_pool_adjacent():
    got = classifier.pool_adjacent(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1.0, 1, 1, 2, 1]))
    assert got == pytest.approx([0.1, 0.3, 0.3, 0.3, 0.9])


def test_pieces_round_trip(docs, none, spark):
    got = pieces.encode(docs, parity_every=1)
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(r["round_trip"] and r["parity"] for r in rows)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(got).collect()}
    for i, t, *_ in ROWS:
        if i is not None and i != 5:
            assert back[i] == (t or "")
    assert pieces.encode(none).count() == 0


def test_unigram_model_is_rebuilt():
    """A unigram model with byte fallback, as a file by hand: encoding takes the best-scored split."""

    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + b"\x15" + np.float32(score).tobytes() + bytes([3 << 3, kind]))

    vocab = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("a", -3, 1), ("b", -3, 1), ("ab", -4, 1), ("▁ab", -5, 1), ("▁a", -4, 1)] + [(f"<0x{i:02X}>", -10, 6) for i in range(256)]
    data = b"".join(piece(*p) for p in vocab) + field(2, bytes([3 << 3, 1]) + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    codec = pieces.Codec(data)
    assert codec.model.kind == pieces.UNIGRAM and codec.model.byte_fallback
    texts = ["ab", "aab ab", "ba é", "", "abab", "a <s> b </s>", "<unk>ab"]
    for t, ids in zip(texts, codec.encode(texts)):
        assert codec.decode(ids) == t
        assert ids.tolist() == codec.reference_ids(t)


def test_mixing(spark, docs, none):
    tokens = [900.0, 90.0, 10.0, 0.0]
    a, w = mixing.solve(tokens, mixing.Target(entropy=0.9, repetition=None))
    assert sum(w) == pytest.approx(1) and w[3] == 0
    assert mixing.entropy(w) == pytest.approx(0.9 * np.log(3), abs=1e-6)
    _, w = mixing.solve(tokens, mixing.Target(entropy=0.9, repetition=3.0))
    assert mixing.repetition(tokens, w, mixing.Target()) == pytest.approx(3.0, rel=1e-6)
    assert mixing.solve([5.0], mixing.Target())[1].tolist() == [1.0] and mixing.solve([], mixing.Target())[1].tolist() == []

    many = mixing.solve([50.0, 3.0], mixing.Target(entropy=0.95, repetition=None), count=np.array([1.0, 40.0]))  # equal sources may come as a count
    single = mixing.solve([50.0] + [3.0] * 40, mixing.Target(entropy=0.95, repetition=None))
    assert many[0] == pytest.approx(single[0]) and many[1][1] == pytest.approx(single[1][7])

    rows = [(i, "w " * 10, "hot" if i % 10 else "cold") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = mixing.Target(entropy=None, repetition=None, budget=30_000.0)
    got = mixing.weigh(df, target)
    read = got.where("epoch is not null")
    by = {r["source"]: r for r in read.groupBy("source").agg(F.sum("tokens").alias("read"), F.max("weight").alias("w")).collect()}
    for r in by.values():  # the budget is met to a block
        assert abs(r["read"] - 30_000 * r["w"]) <= 3 * 40_000 / mixing.BLOCKS + 100
    assert sorted(r["doc_id"] for r in mixing.realise(df, target).collect()) == sorted(r["doc_id"] for r in read.collect())
    assert {r["doc_id"] for r in got.collect()} == set(range(4000))
    whole = mixing.realise(docs, mixing.Target(repetition=1.5))
    assert whole.columns == docs.columns and whole.count() >= len(ROWS)
    assert mixing.weigh(docs, mixing.Target()).select("doc_id", "source").distinct().count() == len({(r[0], r[3]) for r in ROWS})
    assert mixing.weigh(none).count() == 0 and mixing.realise(none).count() == 0


def test_mixing_against_plain_python(spark):
    """Every read of every document, from the same permutations by plain Python."""
    rng = random.Random(12)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choice(["a"] * 12 + ["b", "c", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = mixing.Target(entropy=0.98, repetition=3.0)
    block = {r["doc_id"]: r["b"] for r in df.select("doc_id", mixing.block_of(F.col("doc_id"), target.seed).alias("b")).collect()}
    tokens, blocks = {}, {}
    for i, t, s in rows:
        n = len(t.split())
        tokens[s] = tokens.get(s, 0) + n
        blocks.setdefault(s, {})[block[i]] = blocks.get(s, {}).get(block[i], 0) + n
    names = sorted(tokens, key=str)
    exponent, weights = mixing.solve([tokens[s] for s in names], target)
    assert 0 < exponent < 1  # the target binds
    budget = mixing.budget_of([tokens[s] for s in names], weights, target)
    marks = {(r["b"], r["e"]): r["h"] for r in spark.range(mixing.BLOCKS).select(F.col("id").cast("int").alias("b")).crossJoin(spark.range(6).select(F.col("id").alias("e"))).select("b", "e", F.xxhash64("b", "e", F.lit(target.seed)).alias("h")).collect()}
    turns = {}
    for s, w in zip(names, weights):
        repeat = budget * w / tokens[s]
        assert 1 - 1e-9 <= repeat <= 3 + 1e-6
        for epoch in range(int(repeat + 1e-9) + 1):
            before = 0
            for place, b in enumerate(sorted(blocks[s], key=lambda b: (marks[b, epoch], b))):
                if epoch < int(repeat + 1e-9) or before < (repeat - int(repeat + 1e-9)) * tokens[s] - 0.5:
                    turns.setdefault((s, b), []).append((epoch, place))
                before += blocks[s][b]
    want = [(i, s, e, p) for i, t, s in rows for e, p in turns[s, block[i]]]
    got = [(r["doc_id"], r["source"], r["epoch"], r["place"]) for r in mixing.weigh(df, target).collect()]
    assert as_bag(got) == as_bag(want) and len(got) > len(rows)


def test_sharding(docs, none):
    got = sharding.assign(docs, 16).collect()
    assert len(got) == len(ROWS)
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    assert as_bag((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == as_bag((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert sharding.assign(none).count() == 0

    def wins(i, n):
        """The shard by its definition; the hash is XXH64 of the key's 8 bytes seeded 42, and of the shard's 4 bytes seeded with that."""
        score = {}
        for shard in range(n):
            h = xxhash.xxh64_intdigest(struct.pack("<q", i), 42) if i is not None else 42
            h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
            score[shard] = -1.0 / math.log(((h >> 11) + 0.5) / 2**53)
        return max(score, key=lambda k: (score[k], k))

    for r in got:
        assert (r["shard"], r["grown_shard"]) == (wins(r["doc_id"], 16), wins(r["doc_id"], 17))


def test_weighted_sharding(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    share = {r["shard"]: r["count"] / 20_000 for r in sharding.assign(df, 3, [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert share[1] == pytest.approx(0.5, abs=0.02) and share[0] == pytest.approx(0.25, abs=0.02)
    with pytest.raises(ValueError):
        sharding.assign(df, 2, [0.0, 0.0])


def test_hashes_do_not_depend_on_place():
    raw = np.frombuffer(b"abc abc xabc", np.uint8)
    w = tk.Words(raw, np.array([0, 4, 12]))
    h = w.hashes()
    assert h[0] == h[1] != h[2] and w.count.tolist() == [1, 2]
    r = tk.rolling(raw, 3)
    assert r[0] == r[4] == r[9]
    assert (tk.least_rolling(raw, 3, 2, block=3) == tk.sliding_min(r, 2)).all()


def test_every_language_has_a_model_that_grows(spark):
    """35 languages and null: log_ppl is that of a modified Kneser-Ney model counted in plain Python, with bytes as they are, a language at a time."""
    rng = random.Random(6)
    names = [f"l{i:02}" for i in range(35)] + [None]
    rows = [(3 * i + j, sentence(rng, 30).upper() if j == 2 else sentence(rng, 30), x) for i, x in enumerate(names) for j in range(3)] + [(900, "", "l01"), (901, None, "l01")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.train(df)
    assert len(model.languages) == 36
    got = {r["doc_id"]: r for r in quality.measure(df, model).collect()}
    assert got[900]["log_ppl"] is None and got[901]["log_ppl"] is None and len(got) == len(rows)
    n = quality.ORDER
    for x in (names[0], names[33], names[34], None):
        texts = {i: (b" " * (n - 1) + (t or "").encode()) for i, t, lang in rows if lang == x}
        level = {}
        for t in texts.values():
            for a in range(len(t) - n + 1):
                level[t[a : a + n]] = level.get(t[a : a + n], 0) + 1
        levels = [level]
        for _ in range(n - 1):
            short = {}
            for k in levels[0]:
                short[k[1:]] = short.get(k[1:], 0) + 1
            levels.insert(0, short)
        p = {b"": 1 / 256}
        for level in levels:
            m = [max(sum(c == i for c in level.values()), 1) for i in (1, 2, 3, 4)]
            y = m[0] / (m[0] + 2 * m[1])
            off = [min(max(i - (i + 1) * y * m[i] / m[i - 1], 0.0), 0.95 * i) for i in (1, 2, 3)]
            total, lost, out = {}, {}, {}
            for k, c in level.items():
                total[k[:-1]] = total.get(k[:-1], 0) + c
                lost[k[:-1]] = lost.get(k[:-1], 0) + off[min(c, 3) - 1]
            for k, c in level.items():
                out[k] = (c - off[min(c, 3) - 1] + lost[k[:-1]] * p[k[1:]]) / total[k[:-1]]
            p = out
        for i, t in texts.items():
            if len(t) > n:
                want = -sum(np.log(p[t[a : a + n]]) for a in range(len(t) - n + 1))
                assert got[i]["log_ppl"] * sum(b > 127 or chr(b).isalnum() for b in t) == pytest.approx(want, rel=1e-5)


def test_junk_of_ordinary_letters_is_rejected(spark):
    """Plain words between bars or with signs behind them go, though no letter of them is odd; plain texts stay."""
    rng = random.Random(8)
    plain = [sentence(rng, 60) for _ in range(200)]
    junk = [" | ".join(sentence(rng, 60).split()) for _ in range(6)] + [" ".join(w + rng.choice(["&&&", "$$$", "***"]) for w in sentence(rng, 60).split()) for _ in range(6)]
    df = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(plain + junk)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert not any(got[i]["kept"] for i in range(200, 212))
    assert sum(got[i]["kept"] for i in range(200)) >= 196


def test_keep_one_drops_the_rows_that_the_join_drops(spark):
    """Rows of one key, or null, that repeat another document go; the others of that key stay, whatever their hashes."""
    rng = random.Random(10)
    base = [sentence(rng, 40) for _ in range(20)]
    alone = [sentence(rng, 40) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(None, t + " x") for t in base[:10]] + [(None, t) for t in alone[:10]]
    rows += [(50, t + " y") for t in base[10:]] + [(50, t) for t in alone[10:]] + [(None, ""), (None, ""), (60, None), (60, alone[0] + " z"), (61, "")]
    want = [(i, t) for i, t in enumerate(base)] + [(None, t) for t in alone[1:10]] + [(50, t) for t in alone[10:]] + [(None, ""), (None, ""), (60, None), (60, alone[0] + " z"), (61, "")]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_bag(map(tuple, got.collect())) == as_bag(want)


def test_parity_is_checked_for_every_row(docs):
    whole = pieces.encode(docs)
    assert whole.where("parity is null").count() == 0
    assert as_bag(map(tuple, pieces.encode(docs, keep_ids=False).collect())) == as_bag(map(tuple, whole.drop("ids").collect()))
