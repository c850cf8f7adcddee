"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import textkit as tk
from gleaner.llm.common import discard, materialize, parts

N_FOURIER = 192
#: Width of the Gaussian kernel, in standard deviations of a statistic.
WIDTH = 5.0
RIDGE = 1e-3
SCORE_BINS = 2000
FAN = 16
#: One in so many labelled rows, by a hash of the key, is kept from the fit and calibrates its scores.
CALIBRATE = 4
STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "upper_share", "digit_share", "symbol_share", "punct_share", "space_share", "high_share",
    "distinct_words", "top_word_share", "repeat_next", "repeat_pairs", "log_lines", "words_a_line", "repeat_lines", "all_upper_words", "marked_words",
    "sentence_ends", "bang_share", "bar_share", "short_words", "long_words", "byte_entropy", "vowel_share",
]
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>{}[]\\^~=+_@/"))
_PUNCT = np.isin(np.arange(256), list(b".,;:!?'\"()-"))
_VOWEL = np.isin(np.arange(256), list(b"aeiouyAEIOUY"))


def _count_runs(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: number of distinct keys, most frequent key's count, and items whose key has more than one."""
    if not len(key):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(k)))
    own = d[head]
    most = np.zeros(n)
    np.maximum.at(most, own, size)
    return np.bincount(own, minlength=n).astype(float), most, np.bincount(own, size * (size > 1), minlength=n)


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; all are finite, and zeros for an empty text."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    w = tk.Words(raw, off)
    words = w.count.astype(float)
    share = lambda mask: tk.per_text(mask, off) / np.maximum(size, 1)
    length = (w.end - w.start).astype(float)
    of_words = lambda v: tk.per_text(v, w.cut) / np.maximum(words, 1)
    mean = of_words(length)
    h = w.hashes(tk.lower_ascii(raw))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    distinct, most, _ = _count_runs(h, w.doc, n)
    ok = tk.inside(w.doc, 3)
    triple = tk.windows(h, 3)[ok]
    _, _, repeated = _count_runs(triple, w.doc[: len(ok)][ok], n)
    newline = raw == 10
    lines = tk.per_text(newline, off) + 1.0
    line_start = np.sort(np.concatenate([off[:-1][size > 0], np.flatnonzero(newline) + 1]))
    line_start = np.unique(line_start[line_start < len(raw)])
    line_doc = np.searchsorted(off, line_start, "right") - 1
    at = np.searchsorted(w.start, line_start)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    ends = np.append(at[1:], len(h))
    line_key = tk.mix(total[ends] - total[at])
    filled = ends > at
    _, _, line_repeats = _count_runs(line_key[filled], line_doc[filled], n)
    first, last = raw[w.start], raw[w.end - 1]
    upper = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw >= 65) & (raw <= 90), out=upper[1:])
    capitals = upper[w.end] - upper[w.start]
    counts = np.bincount(np.repeat(np.arange(n), np.diff(off)) * 256 + raw, minlength=n * 256).reshape(n, 256)
    p = counts / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    return np.stack([
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(of_words(length**2) - mean**2, 0)),
        share((raw >= 65) & (raw <= 90)), share((raw >= 48) & (raw <= 57)), share(_SYMBOL[raw]), share(_PUNCT[raw]), share(raw <= 32), share(raw >= 128),
        distinct / np.maximum(words, 1), most / np.maximum(words, 1), of_words(same), repeated / np.maximum(words, 1), np.log(lines), np.log1p(words / lines),
        line_repeats / lines, of_words((capitals >= 2) & (capitals * 2 > length)), of_words(_SYMBOL[first] | _SYMBOL[last]), of_words(last == 46),
        share(raw == 33), share(raw == 124), of_words(length <= 2), of_words(length >= 15), entropy, share(_VOWEL[raw]),
    ], axis=1)


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, stats): the statistics of each whole text, in one pass without a shuffle. A null text counts as empty."""

    def run(batches):
        for part in tk.slices(batches):
            raw, off = tk.bytes_of(part.column("text"))
            x = statistics(raw, off)
            cut = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(cut, pa.array(x.astype(np.float32).ravel()))], ["key", "stats"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(tk.lean(run), f"key {kind}, stats array<float>").withColumnRenamed("key", key)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    coef: np.ndarray
    bin_edges: np.ndarray
    bin_value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase)
        return np.concatenate([wave, z / 8, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.bin_edges, self.bin_value), 0, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width)


def _summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """Sum of make(matrix, labels) over all batches: one vector of a fixed size a task, then partial sums of FAN times fewer, down to FAN, then one."""

    def part(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += make(_matrix(b.column("stats"), len(STATISTICS)), b.column("y").to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def add(batches):
        total = np.zeros(size)
        for b in batches:
            for v in b.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    found, n = rows.mapInArrow(tk.lean(part), "v binary"), parts(rows)
    while n > FAN * FAN:
        n = -(-n // FAN)
        found = found.repartition(n).mapInArrow(tk.lean(add), "v binary")
    got = found.repartition(FAN).mapInArrow(tk.lean(add), "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in got), np.zeros(size))


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to value in weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            both = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / both, both, a[2] + b[2]])
    return np.concatenate([np.full(b[2], b[0]) for b in blocks]) if blocks else np.zeros(0)


def learn(rows: DataFrame, seed: int = 7, later: DataFrame | None = None) -> Model:
    """Fit on all rows (stats array<float>, y 0/1) and calibrate the scores on `later`, rows of the same kind that the fit doesn't see.

    Without rows, or with one class, the score is the prior (0.5 without rows). Where `later` is missing or has one class, rows calibrate themselves.
    """
    width = len(STATISTICS)
    moments = _summed(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * width)
    n, positive = moments[0], moments[1]
    mean = moments[2 : 2 + width] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[2 + width :] / max(n, 1) - mean**2, 1e-8))
    rng = np.random.Generator(np.random.PCG64(seed))
    freq, phase = rng.normal(size=(width, N_FOURIER)) / WIDTH, rng.uniform(0, 2 * np.pi, N_FOURIER)
    size = N_FOURIER + width + 1
    prior = positive / n if n else 0.5
    model = Model(mean, scale, freq, phase, np.zeros(size), np.zeros(1), np.array([prior]))
    if not 0 < positive < n:
        return model

    def normal(x, y):
        f = model.features(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    both = _summed(rows, normal, size * size + size)
    left = both[: size * size].reshape(size, size) / n + RIDGE / size * np.eye(size)
    model.coef = np.linalg.solve(left, both[size * size :] / n)

    lo, hi = -1.0, 2.0

    def bins(x, y):
        at = np.clip(((model.raw(x) - lo) / (hi - lo) * SCORE_BINS).astype(int), 0, SCORE_BINS - 1)
        return np.concatenate([np.bincount(at, minlength=SCORE_BINS), np.bincount(at, y, minlength=SCORE_BINS)]).astype(float)

    hist = _summed(rows if later is None else later, bins, 2 * SCORE_BINS)
    count, ones = hist[:SCORE_BINS], hist[SCORE_BINS:]
    if later is not None and not 0 < ones.sum() < count.sum():
        return learn(rows, seed)
    used = np.flatnonzero(count)
    model.bin_edges = lo + (used + 0.5) * (hi - lo) / SCORE_BINS
    model.bin_value = pool_adjacent(ones[used] / count[used], count[used])
    return model


def score(stats: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """Rows (key, score): the calibrated probability of label 1 for each row of describe()."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sent.value.score(_matrix(b.column("stats"), len(STATISTICS))))], ["key", "score"])

    kind = stats.schema[key].dataType.simpleString()
    return stats.select(stats[key].alias("key"), "stats").mapInArrow(tk.lean(run), f"key {kind}, score double").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, fold, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Rows (key, held_out, score), one for each row of docs, learned from the labelled rows that `fold` (a column of key) doesn't hold out.

    A document with several labels counts once for each; labels that are null, or whose key is null, are not learned from.
    Statistics are computed once and written to the shared folder; they are all that is joined with the labels. Null and empty texts have statistics of
    zeros and get a score as all others; equal texts get equal scores; repeated rows and null keys stay; other columns are ignored. A text
    of any length is taken whole.
    """
    stats, path = materialize(describe(docs, key, text), "stats")
    y = labels.where(labels[label].isNotNull() & labels[key].isNotNull()).select(labels[key].alias(key), labels[label].cast(T.IntegerType()).alias("y"))
    later = F.pmod(F.xxhash64(key, F.lit(41)), F.lit(CALIBRATE)) == 0
    train, train_path = materialize(stats.where(~fold(F.col(key))).join(y, key).select("stats", "y", later.alias("later")), "train")
    model = learn(train.where("not later"), later=train.where("later"))
    discard(docs.sparkSession, train_path)
    return score(stats, model, key).select(key, fold(F.col(key)).alias("held_out"), "score")
