"""Removal of byte strings that other documents hold too, by external induced sorting of suffixes.

Strings of LENGTH bytes that may be shared are found by their least hash of GRAM bytes (the same for equal strings) and
dealt to shards by it, neighbours in one piece. A shard sorts the suffixes of its pieces by induction; equal strings then
stand together, and the smallest document of each group goes back as one bit a string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm import chunks as ck
from gleaner.llm import textkit as tk
from gleaner.llm.common import free_shuffles, materialize, parts
from gleaner.llm.induction import scratch, suffixes

LENGTH = 50
GRAM = 24
#: Shards for each hash range of the counts.
SHARDS = 3
#: A least hash in about so many documents is hot: its strings are dealt one by one, by a hash of their own.
HOT = 900


class Runs:
    """Runs of neighbouring strings of a chunk with the same least hash: first byte, number of strings, hash and text."""

    def __init__(self, c: ck.Chunk):
        n = len(c.raw) - LENGTH + 1
        if n <= 0:
            self.start, self.count, self.least, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        least = tk.least_rolling(c.raw, GRAM, LENGTH - GRAM + 1)
        new = np.ones(n, bool)
        new[1:] = least[1:] != least[:-1]
        new[c.off[:-1][np.diff(c.off) >= LENGTH]] = True
        start = np.flatnonzero(new)
        doc = np.searchsorted(c.off, start, "right") - 1
        stop = np.minimum(np.append(start[1:], n), c.off[doc + 1] - LENGTH + 1)
        real = stop > start
        self.start, self.doc = start[real], doc[real]
        self.count, self.least = stop[real] - self.start, tk.mix(least[self.start])


def run_keys(c: ck.Chunk) -> tuple[np.ndarray, np.ndarray]:
    r = Runs(c)
    return r.least, r.doc


class Pieces:
    """Distinct pieces of a chunk in the order of their shards: for each its place, number of strings and smallest id, and the piece of each run."""

    def __init__(self, c: ck.Chunk, n_shards: int):
        r = Runs(c)
        known = ck.distinct(r.least, r.doc)[0]
        seen = ck.values_of(c, 0)[np.searchsorted(known, r.least)] if len(known) else np.zeros(0, np.uint8)
        hot = seen >= ck.level(np.array([HOT]))[0]
        warm = (seen >= 2) & ~hot
        each = np.repeat(r.start[hot], r.count[hot]) + _counting(r.count[hot])
        self.start = np.concatenate([r.start[warm], each])
        self.count = np.concatenate([r.count[warm], np.ones(len(each), np.int64)])
        self.doc = np.concatenate([r.doc[warm], np.repeat(r.doc[hot], r.count[hot])])
        if not len(self.start):
            self.piece = self.first = self.at = self.strings = self.shard = np.zeros(0, np.int64)
            return
        end = self.start + self.count + LENGTH - 1
        a, b = tk.spans(c.raw, self.start, end, 0), tk.spans(c.raw, self.start, end, 1)  # 128 bits stand for a piece
        route = np.concatenate([tk.mix(r.least[warm]), tk.mix(a[warm.sum() :])])
        shard = ck.part_of(route, n_shards)
        ids = c.ids[self.doc]
        order = np.lexsort((ids, b, a, shard))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.piece = np.empty(len(order), np.int64)
        self.piece[order] = np.cumsum(new) - 1
        pick = order[new]
        self.first, self.at, self.strings, self.shard = ids[pick], self.start[pick], self.count[pick], shard[pick]


def _counting(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of counts, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def smallest_holders(texts: list[bytes], first: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes of each text, in order: the least of `first` of the texts that hold it. Large arrays are mapped from scratch files."""
    size = np.array([len(t) for t in texts])
    strings = size - LENGTH + 1
    base = np.cumsum(strings) - strings
    begin = np.cumsum(size + 1) - size - 1
    symbols = scratch(int((size + 1).sum()), np.uint8)
    owner = scratch(len(symbols), np.int32)
    for i, (t, a) in enumerate(zip(texts, begin.tolist())):  # a separator stays 0, and no byte of UTF-8 is 255
        symbols[a : a + len(t)] = np.frombuffer(t, np.uint8) + np.uint8(1)
        owner[a : a + len(t)] = i
    out = scratch(int(strings.sum()), np.int64)
    shift, final = base - begin, begin + strings
    held: list[tuple[np.ndarray, np.ndarray]] = []  # strings of the group that is still open, and their holders

    def close() -> None:
        if held:
            group, own = (np.concatenate(x) for x in zip(*held))
            out[group] = own.min()
            held.clear()

    broken = True
    for pos, common in suffixes(symbols, LENGTH, begin + strings - 1):
        broken_before = np.cumsum(common < LENGTH)
        text = owner[pos]
        at = np.flatnonzero(pos < final[text])
        if len(at):
            text = text[at]
            group, index, own = broken_before[at], pos[at] + shift[text], first[text]
            new = np.ones(len(at), bool)
            new[1:] = group[1:] != group[:-1]
            head = np.flatnonzero(new)
            cut = np.append(head, len(at))
            if broken or group[0] > 0:
                close()
            if len(head) > 1:
                held.append((index[: cut[1]], own[: cut[1]]))
                close()
                inner = index[cut[1] : cut[-2]]
                if len(inner):
                    marks = cut[1:-2] - cut[1]
                    least = np.minimum.reduceat(own[cut[1] : cut[-2]], marks)
                    out[inner] = np.repeat(least, np.diff(np.append(marks, len(inner))))
                held.append((index[cut[-2] :], own[cut[-2] :]))
            else:
                held.append((index, own))
            broken = bool(broken_before[-1] > group[-1])
        else:
            broken = broken or bool(broken_before[-1] > 0)
    close()
    return out


def sort_shard(rows: list[dict]) -> pa.RecordBatch:
    """The answers (chunk, part, value) of one shard."""
    place: dict[bytes, int] = {}
    firsts: list[int] = []
    own = []
    for r in rows:
        count = np.frombuffer(r["strings"], np.int32).astype(np.int64)
        first = np.frombuffer(r["first"], np.int64)
        ends = np.cumsum(count + LENGTH - 1)
        data = pa.decompress(r["data"], int(ends[-1]), "zstd").to_pybytes()
        mine = []
        at = 0
        for end, f in zip(ends.tolist(), first.tolist()):
            j = place.setdefault(data[at:end], len(firsts))
            at = end
            if j == len(firsts):
                firsts.append(f)
            elif f < firsts[j]:
                firsts[j] = f
            mine.append(j)
        own.append((r["chunk"], np.array(mine), count, first))
    texts = list(place)
    del place
    holders = smallest_holders(texts, np.array(firsts))
    strings = np.array([len(t) - LENGTH + 1 for t in texts])
    base = np.cumsum(strings) - strings
    values = []
    for _, mine, count, first in own:
        where = np.repeat(base[mine], count) + _counting(count)
        values.append(np.packbits(holders[where] < np.repeat(first, count)).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array([o[0] for o in own]), pa.array([rows[0]["part"]] * len(own), pa.int32()), pa.array(values, pa.binary())], ["chunk", "part", "value"]
    )


def sort_shards(pieces: DataFrame, n_shards: int) -> DataFrame:
    """Rows (chunk, part, value): for each piece of the chunk in the shard, a bit a string: 1 if a smaller id than the piece's holds it."""
    return ck.gather(pieces, n_shards).mapInArrow(tk.lean(lambda batches: map(sort_shard, ck.grouped(batches))), "chunk long, part int, value binary")


def pieces_of(chunks: DataFrame, counts: DataFrame, n_shards: int) -> DataFrame:
    """Rows (part, chunk, strings, first, data): the distinct pieces of each chunk that go to a shard."""

    def send(batches):
        for c in ck.each(batches):
            p = Pieces(c, n_shards)
            cut = np.searchsorted(p.shard, np.arange(n_shards + 1))
            size = p.strings + LENGTH - 1
            data = c.raw[np.repeat(p.at, size) + _counting(size)].tobytes()
            ends = np.append(0, np.cumsum(size))
            strings, rows = p.strings.astype(np.int32), []
            for shard in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[shard], cut[shard + 1]
                rows.append((shard, strings[a:b].tobytes(), p.first[a:b].tobytes(), pa.compress(data[ends[a] : ends[b]], "zstd", asbytes=True)))
            if rows:
                shards, *blobs = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int32()), pa.array([c.number] * len(rows)), *(pa.array(x, pa.binary()) for x in blobs)], ["part", "chunk", "strings", "first", "data"]
                )

    return ck.answered(chunks, counts).mapInArrow(tk.lean(send), "part int, chunk long, strings binary, first binary, data binary")


def removed_bytes(c: ck.Chunk, n_shards: int) -> np.ndarray:
    """Which bytes of an answered chunk go."""
    p = Pieces(c, n_shards)
    gone = np.zeros(len(c.raw), bool)
    if not len(p.start):
        return gone
    cut = np.searchsorted(p.shard, np.arange(n_shards + 1))
    bits = {part: v for kind, part, v in c.back if kind == 1}
    base = np.cumsum(p.strings) - p.strings
    flag = np.zeros(int(p.strings.sum()), bool)
    for shard in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[shard], cut[shard + 1]
        n = int(p.strings[a:b].sum())
        flag[base[a] : base[a] + n] = np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=n)
    within = _counting(p.count)
    hit = flag[np.repeat(base[p.piece], p.count) + within] | np.repeat(p.first[p.piece] < c.ids[p.doc], p.count)
    return tk.covered((np.repeat(p.start, p.count) + within)[hit], LENGTH, len(gone))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256[, kept_text, removed][, row]), one for each row of docs.

    Removes each byte of the whole UTF-8 text that a string of 50 bytes covers which also starts in a document with a smaller key, judged on
    the input; matches never cross documents. removed: (start, end) of the maximal removed runs, in bytes. kept_text: the remaining
    bytes, without what is left of cut characters. row: a struct of the columns to carry. A null text is empty; a null key comes after all others; equal keys aren't smaller.
    Keys are whole numbers (others are cast). Texts of any length are whole; a longer one than a chunk (CHUNK_BYTES) is a chunk of its own.
    """
    spark = docs.sparkSession
    n_parts = parts(docs)
    n_shards = SHARDS * n_parts
    chunks, _ = ck.pack(docs, key, text, carry=carry)
    counts, _ = materialize(ck.count_shared(chunks, run_keys, n_parts), "counts")
    free_shuffles(spark)
    bits, _ = materialize(sort_shards(pieces_of(chunks, counts, n_shards), n_shards), "bits")
    free_shuffles(spark)

    def finish(batches):
        for c in ck.each(batches):
            gone = removed_bytes(c, n_shards)
            removed = tk.per_text(gone, c.off)
            start = gone.copy()
            start[1:] &= ~gone[:-1]
            edge = c.off[:-1][np.diff(c.off) > 0]
            start[edge] = gone[edge]
            kept = [c.raw[a:b] if not r else c.raw[a:b][~gone[a:b]] for a, b, r in zip(c.off[:-1], c.off[1:], removed)]
            cols = [c.key_column(), pa.array(np.diff(c.off)), pa.array(removed), pa.array(tk.per_text(start, c.off)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            if keep_text:
                stop = gone.copy()
                stop[:-1] &= ~gone[1:]
                edge = c.off[1:][np.diff(c.off) > 0] - 1
                stop[edge] = gone[edge]
                a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
                base = c.off[np.searchsorted(c.off, a, "right") - 1]
                items = pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], ["start", "end"])
                cols += [pa.array([k.tobytes().decode("utf-8", "ignore") for k in kept], pa.string()), pa.ListArray.from_arrays(pa.array(np.searchsorted(a, c.off).astype(np.int32)), items)]
            if carry:
                cols.append(c.row)
            yield pa.RecordBatch.from_arrays(cols, ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text", "removed"] * keep_text + ["row"] * bool(carry))

    schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string, removed array<struct<start:long,end:long>>" * keep_text
    if carry:
        schema += ", row " + docs.select(*carry).schema.simpleString()
    found = ck.answered(chunks, counts, bits).mapInArrow(tk.lean(finish), schema)
    return found.withColumnRenamed("key", key) if key != "key" else found
