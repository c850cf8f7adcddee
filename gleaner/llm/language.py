"""Language of whole texts and of spans in them.

Scripts narrow the candidate languages of a word, byte-trigram models score it in each, and a Viterbi pass with a
switching penalty labels the words, so that a text of two languages falls into spans.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textkit as tk

UNKNOWN = "und"
GRAM_BITS = 15
#: Nats that a change of language within a text costs.
SWITCH = 12.0
#: With more languages than this, texts are taken in smaller slices, as a slice needs some bytes a word and language.
WIDE = 64
#: A language is a candidate for words of a script that has at least this share of its learned letters.
SCRIPT_SHARE = 0.002
#: First code points of script blocks, and the script of each up to the next.
SCRIPT_STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFE70, 0xFF00, 0x20000]
SCRIPTS = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "other", "indic", "thai", "georgian", "hangul", "other", "latin", "greek", "han", "kana", "kana", "han", "hangul", "other", "han", "arabic", "arabic", "han", "han"]
SCRIPT_NAMES = sorted(set(SCRIPTS))
_SCRIPT_ID = np.array([SCRIPT_NAMES.index(s) for s in SCRIPTS], np.int8)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter (Unicode category L)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes starts, and its code point."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
    first = b[at]
    cp = first.copy()
    two, three, four = (first >= 0xC0) & (first < 0xE0), (first >= 0xE0) & (first < 0xF0), first >= 0xF0
    for mask, size, keep in ((two, 2, 0x1F), (three, 3, 0x0F), (four, 4, 0x07)):
        i = at[mask]
        value = b[i] & keep
        for j in range(1, size):
            value = (value << 6) | (b[i + j] & 0x3F)
        cp[mask] = value
    return at, np.minimum(cp, 0x10FFFF)


class Scan:
    """Words of a slice with letters, their script and the hashed byte trigrams that touch them (one blank before and after)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.words = w = tk.Words(raw, off)
        at, cp = code_points(raw)
        is_letter = letters()[cp]
        self.letter_at = at[is_letter]
        low = tk.lower_ascii(raw).astype(np.uint32)
        inside = np.zeros(len(raw), bool)
        step = np.zeros(len(raw) + 1, np.int32)
        step[w.start] += 1
        np.add.at(step, w.end, -1)
        inside = np.cumsum(step[:-1]) > 0
        digit = (low >= 48) & (low <= 57)
        low = np.where(digit, 48, low)
        low = np.where(inside, low, 32)
        before = np.empty_like(low)
        after = np.empty_like(low)
        if len(low):
            before[1:], after[:-1] = low[:-1], low[1:]
            before[w.start], after[w.end - 1] = 32, 32
        gram = (before * np.uint32(0x01000193) ^ low) * np.uint32(0x01000193) ^ after
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        self.gram = ((gram ^ (gram >> np.uint32(13))) & np.uint32((1 << GRAM_BITS) - 1)).astype(np.int32)
        #: Letters and script of each word: the script of its first letter.
        bound = np.searchsorted(self.letter_at, w.start)
        end = np.searchsorted(self.letter_at, w.end)
        self.n_letters = end - bound
        script = _SCRIPT_ID[np.searchsorted(SCRIPT_STARTS, cp[is_letter], "right") - 1]
        self.script = np.where(self.n_letters > 0, np.append(script, 0)[np.minimum(bound, len(script))], -1)


@dataclass
class Model:
    languages: list[str]
    log_share: np.ndarray  # language x gram
    allowed: np.ndarray  # script x language


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Count byte trigrams and letters by script of every row of docs with a language, for every language there is.

    Counts are summed in each task before the shuffle; a language has at most 2**GRAM_BITS + len(SCRIPT_NAMES) of them,
    whatever the size of docs. They become a vector a language on the executors, and those come to the driver: some 130 kB for each language.
    Rows whose language or text is null are not learned from; repeated rows count each time.
    """
    rows = docs.where(docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[lang].alias("lang"), docs[text].alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        size = (1 << GRAM_BITS) + len(SCRIPT_NAMES)
        for part in tk.slices(batches):
            raw, off = tk.bytes_of(part.column("text"))
            scan = Scan(raw, off)
            names = part.column("lang").to_pylist()
            step = np.zeros(len(raw) + 1, np.int32)
            step[scan.words.start[scan.n_letters > 0]] += 1
            np.add.at(step, scan.words.end[scan.n_letters > 0], -1)
            use = np.cumsum(step[:-1]) > 0
            for i, name in enumerate(names):
                own = total.setdefault(name, np.zeros(size, np.int64))
                a, b = off[i], off[i + 1]
                own[: 1 << GRAM_BITS] += np.bincount(scan.gram[a:b][use[a:b]], minlength=1 << GRAM_BITS)
                a, b = scan.words.cut[i], scan.words.cut[i + 1]
                s = scan.script[a:b]
                own[1 << GRAM_BITS :] += np.bincount(s[s >= 0], scan.n_letters[a:b][s >= 0], minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for name, own in total.items():
            at = np.flatnonzero(own)
            yield tk.batch(["lang", "slot", "n"], [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])])

    counts = rows.mapInArrow(tk.lean(count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))

    def vector(table: pa.Table) -> pa.Table:
        own = np.zeros((1 << GRAM_BITS) + len(SCRIPT_NAMES))
        own[table.column("slot").to_numpy()] = table.column("n").to_numpy()
        grams = own[: 1 << GRAM_BITS] + 0.5
        values = [table.column("lang")[0].as_py(), np.log(grams / grams.sum()).astype(np.float32).tobytes(), own[1 << GRAM_BITS :].tobytes()]
        return pa.table([pa.array([v]) for v in values], ["lang", "shares", "scripts"])

    found = sorted(counts.groupBy("lang").applyInArrow(vector, "lang string, shares binary, scripts binary").collect(), key=lambda r: r["lang"])
    share = np.stack([np.frombuffer(r["shares"], np.float32) for r in found]) if found else np.zeros((0, 1 << GRAM_BITS), np.float32)
    script = np.stack([np.frombuffer(r["scripts"]) for r in found]) if found else np.zeros((0, len(SCRIPT_NAMES)))
    allowed = (script / np.maximum(script.sum(1, keepdims=True), 1) >= SCRIPT_SHARE).T
    return Model([r["lang"] for r in found], share, allowed)


def label_words(model: Model, scan: Scan, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """Label of each word (-1: no letters) by Viterbi, and its margin: log score over the mean of the other candidates'."""
    w, n_lang = scan.words, len(model.languages)
    score = np.empty((len(w.start), n_lang), np.float32)
    total = np.zeros(len(w.raw) + 1)
    for i in range(n_lang):
        np.cumsum(model.log_share[i][scan.gram], dtype=np.float64, out=total[1:])
        score[:, i] = total[w.end] - total[w.start]
    real = scan.n_letters > 0
    allowed = model.allowed[np.maximum(scan.script, 0)]
    narrow = real[:, None] & ~allowed & allowed.any(1)[:, None]
    score[narrow] -= 50.0
    score[~real] = 0.0
    # Words of all texts at once, the t-th word of each text in step t, longest texts first.
    longest = np.argsort(-w.count, kind="stable")
    first = w.cut[:-1][longest]
    sizes = w.count[longest]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")
    back = np.zeros((len(w.start), n_lang), np.int16)
    best = np.zeros((len(sizes), n_lang))
    for t in range(steps):
        k = active[t]
        at = first[:k] + t
        if t:
            prev = best[:k]
            top = prev.argmax(1)
            jump = prev[np.arange(k), top][:, None] - switch
            stay = prev >= jump
            back[at] = np.where(stay, np.arange(n_lang), top[:, None])
            best[:k] = np.where(stay, prev, jump) + score[at]
        else:
            best[:k] = score[at]
    label = np.full(len(w.start), -1, np.int16)
    state = best.argmax(1) if n_lang else np.zeros(len(sizes), int)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        label[at] = state[:k]
        state[:k] = back[at, state[:k]]
    if n_lang > 1:
        own = score[np.arange(len(score)), np.maximum(label, 0)]
        margin = own - (score.sum(1) - own) / (n_lang - 1)
    else:
        margin = np.ones(len(score))
    label[~real] = -1
    return label, margin


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH, spans: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Rows (key, lang_pred, score[, spans][, row]), one for each row of docs, from the whole text alone.

    lang_pred is the language of most letters, `und` if the text is null or has no letter (or nothing was learned);
    score is the share of letters labelled so, times 1 / (1 + exp(-margin a word)). spans: (start, end, lang), byte offsets of
    maximal runs of words of one language. row: a struct of the columns to carry. Ties go to the language that sorts first; repeated rows and null keys stay.
    A text is labelled as a whole, however long: a task holds some 6 bytes for each of its words and languages.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches):
        m = sent.value
        n_lang = len(m.languages)
        for part in tk.slices(batches, limit=2 * tk.SLICE_BYTES * WIDE // max(n_lang, WIDE)):
            raw, off = tk.bytes_of(part.column("text"))
            n = len(off) - 1
            scan = Scan(raw, off)
            w = scan.words
            label, margin = label_words(m, scan, switch) if n_lang else (np.full(len(w.start), -1), np.zeros(len(w.start)))
            real = label >= 0
            weight = np.bincount(w.doc[real] * max(n_lang, 1) + label[real], scan.n_letters[real], minlength=n * max(n_lang, 1)).reshape(n, -1)
            every = weight.sum(1)
            best = weight.argmax(1)
            mean = np.bincount(w.doc[real], np.clip(margin[real], -30, 30), minlength=n) / np.maximum(np.bincount(w.doc[real], minlength=n), 1)
            score = np.where(every > 0, weight.max(1, initial=0) / np.maximum(every, 1) / (1 + np.exp(-mean)), 0.0)
            names = [m.languages[b] if e > 0 else UNKNOWN for b, e in zip(best, every)]
            cols = [part.column("key"), pa.array(names, pa.string()), pa.array(score)]
            if spans:
                at = np.flatnonzero(real)
                new = np.ones(len(at), bool)
                new[1:] = (label[at][1:] != label[at][:-1]) | (w.doc[at][1:] != w.doc[at][:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(at))[: len(head)] - 1
                d = w.doc[at][head] if len(at) else np.zeros(0, int)
                items = pa.StructArray.from_arrays(
                    [pa.array(w.start[at][head] - off[d]), pa.array(w.end[at][tail] - off[d]), pa.array([m.languages[i] for i in label[at][head]], pa.string())], fields=list(span)
                )
                cut = np.searchsorted(d, np.arange(n + 1)).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(cut), items))
            if carry:
                cols.append(part.column("row"))
            yield pa.RecordBatch.from_arrays(cols, ["key", "lang_pred", "score"] + ["spans"] * spans + ["row"] * bool(carry))

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), *([F.struct(*(docs[c] for c in carry)).alias("row")] if carry else []))
    if carry:
        schema += ", row " + docs.select(*carry).schema.simpleString()
    return rows.mapInArrow(tk.lean(run), schema).withColumnRenamed("key", key)
