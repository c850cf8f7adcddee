"""Quality rules: plain counts of a text, and perplexity bands from a modified Kneser-Ney model counted by Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import chunks as ck
from gleaner.llm import textkit as tk
from gleaner.llm.common import discard, join_counted, materialize, materialize_counted, parts

#: The model's symbols are bytes as they are. An n-gram is a number of ORDER bytes, newest lowest; a text follows blanks.
BITS = 8
ORDER = 5
BLANK = 32
#: Stands for null, which is a language of its own.
REST = "\x00rest"
#: Bytes of text whose distinct n-grams are looked up at once.
CHUNK_BYTES = 4 << 20
#: A document is kept while its log perplexity a letter is this close to its language's median, in units of the language's robust spread.
#: Both numbers have the largest difference of rejected junk and rejected clean documents among the labels of the learning fold (README).
BAND = 3.0
#: Texts of n bytes vary by about 1/sqrt(n) more.
BAND_SHORT = 1.0
PERPLEXITY_STEP = 0.005
#: Log perplexities a letter from here on count as this one where bands are drawn: of texts with hardly a letter. So a language has a bounded number of steps.
PERPLEXITY_TOP = 64.0
#: Bands of so many languages are broadcast, some 100 bytes each.
MOST_BROADCAST = 100_000
REPEAT_WINDOW = 5
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Digits, A-Z, a-z and bytes above 127.
_LETTER = np.array([chr(i).isalnum() or i > 127 for i in range(256)])


def text_counts(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """For each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(off) - 1
    w = tk.Words(raw, off)
    char_start = ((raw & 0xC0) != 0x80) & ~np.isin(raw, list(tk.SPACES))
    h = w.hashes()
    at = np.flatnonzero(tk.inside(w.doc, REPEAT_WINDOW))
    key = tk.windows(h, REPEAT_WINDOW)[at] if len(at) else np.zeros(0, np.uint64)
    doc = w.doc[at]
    order = np.lexsort((key, doc))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = at[order[same[1:] | same[:-1]]]
    repeat = tk.covered(twice, REPEAT_WINDOW, len(w.start))
    data = raw.tobytes()
    dup = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        lines = [x for x in data[a:b].split(b"\n") if x.strip(tk.SPACES)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": w.count,
        "word_chars": tk.per_text(char_start, off),
        "n_symbols": tk.per_text(_SYMBOL[raw], off),
        "n_dup_lines": np.array(dup, np.int64).reshape(n),
        "n_repeat_words": tk.per_text(repeat, w.cut),
    }


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, packed into an integer, newest symbol lowest, and whether it lies in one text; what is before a text counts as blanks."""
    code = raw.astype(np.int64)
    key = np.zeros(len(code), np.int64)
    for j in range(ORDER):
        part = np.full(len(code), BLANK, np.int64)
        part[j:] = code[: len(code) - j] if j else code
        key |= part << (BITS * j)
    whole = np.ones(len(code), bool)
    for j in range(ORDER - 1):
        at = off[:-1] + j
        at = at[at < off[1:]]
        whole[at] = False
        key[at] = (key[at] & ((1 << (BITS * (j + 1))) - 1)) | sum(BLANK << (BITS * q) for q in range(j + 1, ORDER))
    return key, whole


@dataclass
class KneserNey:
    """Tables in the shared folder, for each order: n-grams (lang, gram, p) with their probability, and contexts (lang, context, back) with back-off weights."""

    tables: list[tuple[DataFrame, DataFrame]]
    paths: list[str]

    @property
    def languages(self) -> list[str]:
        return sorted(r["lang"] for r in self.tables[0][0].select("lang").distinct().collect())

    def log_prob(self, lang: int, key: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each n-gram's last symbol after the ones before it; a look at single n-grams, seen or not."""
        name, rows = self.languages[lang], None
        key = np.asarray(key, np.int64)
        for order, (seen, contexts) in enumerate(self.tables, 1):
            low = key & ((1 << (BITS * order)) - 1)
            for kind, table, column, value, wanted in ((0, seen, "gram", "p", low), (1, contexts, "context", "back", low >> BITS)):
                own = table.where((F.col("lang") == name) & F.col(column).isin(np.unique(wanted).tolist())).select(F.lit(order).alias("o"), F.lit(kind).alias("kind"), F.col(column).alias("k"), F.col(value).alias("v"))
                rows = own if rows is None else rows.union(own)
        found = {(r["o"], r["kind"], r["k"]): r["v"] for r in rows.collect()}
        out = np.full(len(key), 1.0 / (1 << BITS))
        for order in range(1, ORDER + 1):
            low = key & ((1 << (BITS * order)) - 1)
            back = np.array([found.get((order, 1, k), 1.0) for k in (low >> BITS).tolist()])
            out = np.array([found.get((order, 0, k), p) for k, p in zip(low.tolist(), (back * out).tolist())])
        return np.log(np.maximum(out, 1e-12))


def _smoothed(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of n-grams (lang, gram, n) of one order: (lang, gram, context, share) and (lang, context, back), by three discounts a language."""
    seen = level.groupBy("lang").agg(*(F.greatest(F.sum((F.col("n") == i).cast("long")), F.lit(1)).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.0)), F.lit(0.95 * i)) for i in (1, 2, 3)]
    seen = seen.select("lang", *(x.alias(f"d{i}") for i, x in enumerate(d, 1)))
    lost = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = level.join(F.broadcast(seen), "lang").select("lang", "gram", F.shiftright("gram", BITS).alias("context"), "n", lost.alias("lost"))
    sums = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("lost").alias("gone"))
    shares = rows.join(sums, ["lang", "context"]).select("lang", "gram", "context", ((F.col("n") - F.col("lost")) / F.col("total")).alias("share"))
    return shares, sums.select("lang", "context", (F.col("gone") / F.col("total")).alias("back"))


def _language(lang: str) -> F.Column:
    return F.coalesce(F.col(lang), F.lit(REST))


def _by_language(langs: list[str], off: np.ndarray) -> dict[str, list[tuple[int, int]]]:
    """Where the texts of each language start and end."""
    out: dict[str, list[tuple[int, int]]] = {}
    for name, a, b in zip(langs, off[:-1].tolist(), off[1:].tolist()):
        out.setdefault(name, []).append((a, b))
    return out


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> KneserNey:
    """Count the n-grams of every document, language by language, and smooth them (modified Kneser-Ney).

    A task sums its own counts before the shuffle. All tables are written to the shared folder and joined; they grow with the n-grams
    that the input has, and none comes to the driver. Every language has a model of its own, null too. Discounts (a row a language) are broadcast.
    """

    def count(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list] = {}

        def merge(name):
            parts_ = waiting.pop(name)
            if name in total:
                parts_.append(total[name])
            k, c = (np.concatenate(x) for x in zip(*parts_))
            k, at = np.unique(k, return_inverse=True)
            total[name] = k, np.bincount(at, c).astype(np.int64)

        def flush():
            for name in list(waiting):
                merge(name)
            for name, (k, c) in total.items():
                for a in range(0, len(k), 1 << 16):
                    own = k[a : a + (1 << 16)]
                    yield tk.batch(["lang", "gram", "n"], [pa.array([name] * len(own), pa.string()), pa.array(own), pa.array(c[a : a + (1 << 16)])])
            total.clear()

        for part in tk.slices(batches):
            raw, off = tk.bytes_of(part.column("text"))
            key, _ = grams(raw, off)
            for name, own in _by_language(part.column("lang").to_pylist(), off).items():
                waiting.setdefault(name, []).append(np.unique(np.concatenate([key[a:b] for a, b in own]), return_counts=True))
                if len(waiting[name]) >= 16:
                    merge(name)
            if sum(len(k) for k, _ in total.values()) > 8 << 20:  # a task's memory is bounded
                yield from flush()
        yield from flush()

    rows = docs.select(_language(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = rows.mapInArrow(tk.lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    level, path = materialize(counted, "ngrams")
    levels, done = [(level, path)], []
    for order in range(ORDER - 1, 0, -1):
        # a shorter n-gram counts once for each symbol seen before it
        short = F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))
        levels.insert(0, materialize(levels[0][0].groupBy("lang", short.alias("gram")).agg(F.count("*").alias("n")), "ngrams"))
    tables, lower = [], None
    for order, (level, _) in enumerate(levels, 1):
        shares, contexts = _smoothed(level)
        contexts, path = materialize(contexts, "contexts")
        rows = shares.join(contexts, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / (1 << BITS)))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))
            rows = rows.withColumn("suffix", suffix).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        lower, path_ = materialize(rows.select("lang", "gram", (F.col("share") + F.col("back") * F.col("below")).alias("p")), "probabilities")
        tables.append((lower, contexts))
        done += [path, path_]
    discard(docs.sparkSession, *(path for _, path in levels))
    return KneserNey(tables, done)


def _distinct(c: ck.Chunk, n_parts: int) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """The languages of a chunk, for each its sorted distinct n-grams, their hash ranges, and the bytes that it has; and the n-gram at each byte."""
    key, _ = grams(c.raw, c.off)
    texts = _by_language(c.row.field("lang").to_pylist(), c.off)
    names, out = sorted(texts), []
    for name in names:
        mine = np.concatenate([np.arange(a, b) for a, b in texts[name]])
        k = np.unique(key[mine])
        out.append((k, ck.part_of(tk.mix(k.view(np.uint64)), n_parts), mine))
    return names, out, key


def _planes(x: np.ndarray) -> bytes:
    """Floats byte plane by byte plane, of which those of the exponents compress well."""
    return np.ascontiguousarray(x.astype(np.float32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _floats(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.float32).ravel()


def _looked_up(chunks: DataFrame, model: KneserNey, n_parts: int) -> DataFrame:
    """Rows (chunk, part, value): the log probabilities of the chunk's distinct n-grams of a hash range, language by language, in order.

    Both sides go to the hash ranges as sorted binary blocks; a range is a task's work, and there are as many as shuffle partitions.
    """

    def block(part, chunk, names, keys, values):
        return part, chunk, names, b"".join(ck.sorted_packed(k.view(np.uint64)) for k in keys), values

    def batch(rows):
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["part", "chunk", "langs", "low", "p"])

    def send(batches):
        for c in ck.each(batches):
            names, found, _ = _distinct(c, n_parts)
            by_part: dict[int, list] = {}
            for name, (k, part, _) in zip(names, found):
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(n_parts + 1))
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    by_part.setdefault(p, []).append((name, k[order[cut[p] : cut[p + 1]]]))
            if by_part:
                yield batch([block(p, c.number, [x for x, _ in own], [k for _, k in own], None) for p, own in sorted(by_part.items())])

    def pack(batches):
        def flush(held):
            table = pa.Table.from_batches(held)
            name, k, v = table.column("lang").to_numpy(), table.column("gram").to_numpy(), np.log(table.column("p").to_numpy()).astype(np.float32)
            part = ck.part_of(tk.mix(k.view(np.uint64)), n_parts)
            for x in sorted(set(name)):
                mine = np.flatnonzero(name == x)
                mine = mine[np.lexsort((k[mine], part[mine]))]
                cut = np.searchsorted(part[mine], np.arange(n_parts + 1))
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    own = mine[cut[p] : cut[p + 1]]
                    yield batch([block(p, None, [x], [k[own]], _planes(v[own]))])

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 1 << 20:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    def keys_of(row):
        data, out = memoryview(row["low"]), {}
        for x in row["langs"]:
            out[x] = ck.sorted_unpacked(data).view(np.int64)
            data = data[ck.packed_size(data) :]
        return out

    def answer(batches):
        for rows in ck.grouped(batches):
            known: dict[str, list] = {}
            for r in rows:
                if r["chunk"] is None:
                    ((x, k),) = keys_of(r).items()
                    known.setdefault(x, []).append((k, _floats(r["p"])))
            table = {}
            for x, own in known.items():
                k, v = (np.concatenate(y) for y in zip(*own))
                order = np.argsort(k)
                table[x] = k[order], v[order]
            for r in rows:
                if r["chunk"] is None:
                    continue
                out = []
                for x, wanted in keys_of(r).items():
                    k, v = table[x]
                    at = np.minimum(np.searchsorted(k, wanted), len(k) - 1)
                    if not (k[at] == wanted).all():
                        raise ValueError("an n-gram that the model has not counted")
                    out.append(v[at])
                yield tk.batch(["chunk", "part", "value"], [pa.array([r["chunk"]]), pa.array([r["part"]], pa.int32()), pa.array([_planes(np.concatenate(out))], pa.binary())])

    schema = "part int, chunk long, langs array<string>, low binary, p binary"
    rows = chunks.mapInArrow(tk.lean(send), schema).union(model.tables[-1][0].mapInArrow(tk.lean(pack), schema))
    return ck.gather(rows, n_parts).mapInArrow(tk.lean(answer), "chunk long, part int, value binary")


def measure(docs: DataFrame, model: KneserNey, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Rows (key, model, n_bytes, log_ppl, counts of text_counts), one for each row of docs, which model has counted; log_ppl is null for an empty text.

    log_ppl is the surprise of all bytes for each letter, as bars, signs and blanks that repeat are easily foreseen and would dilute it.
    """
    spark = docs.sparkSession
    n_parts = parts(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = docs.select(F.lit(0).alias("zero"), docs[key].alias("key"), _language(lang).alias("lang"), docs[text].alias("text"))
    chunks, packed = ck.pack(rows, "zero", "text", size=CHUNK_BYTES, carry=["key", "lang"])

    def run(batches):
        for c in ck.each(batches):
            langs, found, gram = _distinct(c, n_parts)
            sent = {p: _floats(v) for _, p, v in c.back}
            used = dict.fromkeys(sent, 0)
            value = np.zeros(len(gram))
            for k, part, mine in found:
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(n_parts + 1))
                p = np.empty(len(k))
                for q in np.flatnonzero(np.diff(cut)).tolist():
                    n = cut[q + 1] - cut[q]
                    p[order[cut[q] : cut[q + 1]]] = sent[q][used[q] : used[q] + n]
                    used[q] += n
                value[mine] = p[np.searchsorted(k, gram[mine])]
            counts = text_counts(c.raw, c.off)
            size = np.diff(c.off)
            ppl = pa.array(-tk.per_text(value, c.off) / np.maximum(tk.per_text(_LETTER[c.raw], c.off), 1), mask=size == 0)
            out = pa.RecordBatch.from_arrays([c.row.field("key"), c.row.field("lang"), pa.array(size), ppl, *(pa.array(counts[x].astype(np.int64)) for x in names)], ["key", "model", "n_bytes", "log_ppl", *names])
            yield out

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, model string, n_bytes long, log_ppl double, " + ", ".join(f"{x} long" for x in names)
    found = ck.answered(chunks, _looked_up(chunks, model, n_parts)).mapInArrow(tk.lean(run), schema).withColumnRenamed("key", key)
    out, _ = materialize(found, "measured")
    ck.release(spark, packed)
    return out


def bands(measured: DataFrame) -> DataFrame:
    """Rows (model, n, median, spread): of the log perplexity of each language's n documents, null if all are empty; from a histogram of fixed steps over all of them.

    A language has PERPLEXITY_TOP / PERPLEXITY_STEP steps at most, which one task sees; languages are spread over tasks.
    """
    step = F.floor(F.least(F.col("log_ppl"), F.lit(PERPLEXITY_TOP)) / PERPLEXITY_STEP).cast("int")
    steps = measured.groupBy("model", F.when(F.col("log_ppl").isNotNull(), step).alias("step")).agg(F.count("*").alias("n"))

    def draw(key: tuple[pa.Scalar], own: pa.Table) -> pa.Table:
        n, full = own.column("n").to_numpy(), own.filter(own.column("step").is_valid())
        value, weight = (full.column("step").to_numpy().astype(float) + 0.5) * PERPLEXITY_STEP, full.column("n").to_numpy()

        def middle(v: np.ndarray) -> float:
            order = np.argsort(v)
            return float(v[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)])

        median = middle(value) if len(value) else None
        spread = max(1.4826 * middle(np.abs(value - median)), PERPLEXITY_STEP) if len(value) else None
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([int(n.sum())]), pa.array([median], pa.float64()), pa.array([spread], pa.float64())], ["model", "n", "median", "spread"])

    return steps.groupBy("model").applyInArrow(draw, "model string, n long, median double, spread double")


def judge(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", band: float = BAND) -> DataFrame:
    """Rows (key, counts, log_ppl, lower, upper, base_failed, kept), one for each row of docs.

    base_failed: fewer than 10 words, or more than 20 % of the words in repeated 5-word windows. kept: not base_failed, and the log
    perplexity a letter under its language's model lies in that language's band (lower, upper), which is wider for short texts. A null text
    has no words. Texts without a letter, of any length, are judged like others: their log perplexity counts as one letter's. Repeated rows and null keys stay;
    other columns, whatever their names, are ignored. Bands, a row a language, are broadcast up to MOST_BROADCAST of them, and joined beyond that.
    """
    model = train(docs, lang, text)
    measured = measure(docs, model, key, lang, text)
    discard(docs.sparkSession, *model.paths)
    drawn, _, languages = materialize_counted(bands(measured), "bands")
    if languages <= MOST_BROADCAST:
        joined = measured.join(F.broadcast(drawn.drop("n")), "model")
    else:
        joined = join_counted(measured, drawn, "model", measured.count(), key)
    width = F.lit(band) * F.col("spread") + F.lit(BAND_SHORT) / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    joined = joined.withColumn("lower", F.col("median") - width).withColumn("upper", F.col("median") + width)
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(False))
    return joined.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_ppl", "lower", "upper"
    )


