"""Incremental removal of repeated word windows by a log-structured index of window fingerprints.

The index lies in a folder and outlives a call: immutable runs of fingerprints, each a table bucketed by hash range and sorted within it. The windows
of a batch of documents are shuffled to those ranges and merge-joined there with every run, which stay where they are; hits must agree in
further bits of an independent hash. What is new becomes one more run. Runs have a level, and FAN of one level are compacted into one of the next, range by range, before a batch comes
in: an entry is copied as often as there are levels, whose number grows with the logarithm of the batches, and no more is on disk twice than the runs of one level.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import chunks as ck
from gleaner.llm import textkit as tk
from gleaner.llm.common import discard, free_shuffles, materialize, parts, shared_folder

WINDOW = 13
BATCHES = 4
FAN = 2
#: Ranges of the index for each hash range of the input.
RANGES = 4
_ENTRY = "kind int, part int, chunk long, h binary, v binary, first binary"
_COLUMNS = ["kind", "part", "chunk", "h", "v", "first"]


class Entries:
    """Distinct windows of a chunk in order: hash h, 16 bits v of another, the smallest id that has each; and each window's entry."""

    def __init__(self, c: ck.Chunk):
        self.words = w = tk.Words(c.raw, c.off)
        self.at = at = np.flatnonzero(tk.inside(w.doc, WINDOW))
        self.entry = np.zeros(0, np.int64)
        if not len(at):
            self.h, self.v, self.first = np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64)
            return
        a = tk.windows(w.hashes(), WINDOW)[at]
        b = (tk.windows(w.hashes(family=1), WINDOW, 0x9FB21C651E98DF25)[at] >> np.uint64(48)).astype(np.uint16)
        order = np.argsort(a)
        a, b, ids = a[order], b[order], c.ids[w.doc[at[order]]]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.flatnonzero(new)
        self.h, self.v, self.first = a[head], b[head], np.minimum.reduceat(ids, head)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1


def _distinct(h: np.ndarray, v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (h, v) with the least first."""
    order = np.argsort(h, kind="stable")
    h, v, first = h[order], v[order], first[order]
    tied = np.flatnonzero((h[1:] == h[:-1]) & (v[1:] != v[:-1]))
    if len(tied):  # two windows share the first hash
        order = np.lexsort((v, h))
        h, v, first = h[order], v[order], first[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (v[1:] != v[:-1])
    head = np.flatnonzero(new)
    return h[head], v[head], np.minimum.reduceat(first, head) if len(head) else first


def merge_join(run: tuple, wanted: tuple) -> np.ndarray:
    """For each wanted (h, v), both sides sorted: the first id of the same entry of the run, LAST where there is none."""
    h, v, first = run
    out = np.full(len(wanted[0]), ck.LAST)
    lo = np.searchsorted(h, wanted[0], "left")
    live = np.flatnonzero(lo < len(h))
    while len(live):  # again only where two windows share the first hash
        live = live[h[lo[live]] == wanted[0][live]]
        hit = live[v[lo[live]] == wanted[1][live]]
        out[hit] = np.minimum(out[hit], first[lo[hit]])
        lo[live] += 1
        live = live[lo[live] < len(h)]
    return out


def _row(kind: int, part: int, chunk: int | None, h=None, v=None, first=None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, part, chunk, h, v, first), kinds)], _COLUMNS)


def _encoded(h: np.ndarray, v: np.ndarray, first: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return ck.sorted_packed(h), v.tobytes(), ck.packed(first.view(np.uint64))


def _decoded(h, v, first) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ck.sorted_unpacked(h), np.frombuffer(v, np.uint16), ck.unpacked(first).view(np.int64)


class FingerprintIndex:
    """Runs of window fingerprints in a folder; ranges is the number of hash ranges, fixed when the index is made, of which a task holds one at a time."""

    def __init__(self, spark: SparkSession, path: str, ranges: int, runs: list[str] | None = None, fan: int | None = None, levels: list[int] | None = None):
        self.spark, self.path, self.ranges, self.runs, self.fan = spark, path, ranges, runs or [], fan or FAN
        self.levels = levels or [0] * len(self.runs)
        self.tables: dict[str, str] = {}
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str, fan: int | None = None) -> FingerprintIndex:
        """The index that an earlier call saved there."""
        rows = [r.asDict() for r in spark.read.option("mergeSchema", "true").parquet(f"{path}/manifest").collect()]  # a row a version and run
        version = max(r["version"] for r in rows)
        own = sorted((r for r in rows if r["version"] == version), key=lambda r: r["at"])
        out = cls(spark, path, own[0]["ranges"], [r["run"] for r in own if r["run"]], fan, [r.get("level") or 0 for r in own if r["run"]])
        out.version = version
        return out

    def save(self) -> None:
        """Write down which runs there are; a reader sees the newest list whole."""
        self.version += 1
        rows = [(self.version, i, self.ranges, r, level) for i, (r, level) in enumerate(zip(self.runs, self.levels))] or [(self.version, 0, self.ranges, None, None)]
        self.spark.createDataFrame(rows, "version int, at int, ranges int, run string, level int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _table(self, run: str) -> DataFrame:
        """A run as a table that Spark knows to be bucketed, so that reading it needs no shuffle."""
        if run not in self.tables:  # of an earlier call
            name = self.tables[run] = f"run_{uuid.uuid4().hex}"
            columns = "part int, chunk long, h binary, v binary, first binary, kind int"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (kind) CLUSTERED BY (part) INTO {self.ranges} BUCKETS LOCATION '{run}'")
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.spark.table(self.tables[run])

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        run = f"{self.path}/{name}"
        rows.write.partitionBy("kind").bucketBy(self.ranges, "part").option("path", run).option("compression", "zstd").saveAsTable(name)
        self.tables[run] = name
        return run

    def _with_runs(self, rows: DataFrame | None, runs: list[str]) -> DataFrame:
        for i, run in enumerate(runs):
            own = self._table(run).where("kind = 1").select("part", F.lit(-1).cast("long").alias("chunk"), F.lit(i).alias("run"), "h", "v", "first")
            rows = own if rows is None else rows.union(own)
        return rows

    def add(self, entries: DataFrame) -> DataFrame:
        """Look up a batch and add it: entries (part, chunk, h, v, first), sorted distinct windows of a chunk in a hash range.

        Returns rows (chunk, part, value): a bit for each window, 1 if a smaller id has it, in this batch or an earlier one.
        Batches may come in any order of ids; a window's smallest id is kept, by a newer run if need be. Only the batch is shuffled.
        """
        while len(self.runs) >= self.fan and self.levels[-self.fan] == self.levels[-1]:
            self.compact(self.fan)
        batch = entries.select("part", "chunk", F.lit(-1).alias("run"), "h", "v", "first").repartition(self.ranges, "part")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, chunks, own, runs = 0, [], [], []
            for b in batches:
                for i in range(b.num_rows):
                    part = b.column("part")[i].as_py()
                    blobs = [b.column(c)[i].as_buffer() for c in ("h", "v", "first")]
                    if b.column("run")[i].as_py() < 0:
                        chunks.append(b.column("chunk")[i].as_py())
                        own.append(_decoded(*blobs))
                    else:
                        runs.append(blobs)  # decoded one after another below
            if not own:
                return
            h, v, first = _distinct(*(np.concatenate(x) for x in zip(*own)))
            old = np.full(len(h), ck.LAST)
            for blobs in runs:
                old = np.minimum(old, merge_join(_decoded(*blobs), (h, v)))
            least = np.minimum(first, old)
            for chunk, (a, b, c) in zip(chunks, own):
                yield _row(0, part, chunk, np.packbits(merge_join((h, v, least), (a, b)) < c).tobytes())
            fresh = first < old
            if fresh.any():
                yield _row(1, part, None, *_encoded(h[fresh], v[fresh], first[fresh]))

        run = self._write(self._with_runs(batch, self.runs).groupBy("part").applyInArrow(merge, _ENTRY))
        self.runs.append(run)
        self.levels.append(0)
        if not ck.exists(self.spark, f"{run}/kind=0"):
            return self.spark.createDataFrame([], "chunk long, part int, value binary")
        return self.spark.read.schema("chunk long, part int, h binary").parquet(f"{run}/kind=0").withColumnRenamed("h", "value")

    def compact(self, last: int | None = None) -> None:
        """Merge the last runs (all by default) into one a level above theirs, which keeps each window's smallest id; nothing is shuffled. Answers that were written with the old runs stay."""

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, part = [], 0
            for b in batches:
                for i in range(b.num_rows):
                    part = b.column("part")[i].as_py()
                    held.append(_decoded(*(b.column(c)[i].as_buffer() for c in ("h", "v", "first"))))
            yield _row(1, part, None, *_encoded(*_distinct(*(np.concatenate(x) for x in zip(*held)))))

        own = self.runs[-last:] if last else self.runs
        if len(own) > 1:
            new = self._write(self._with_runs(None, own).groupBy("part").applyInArrow(merge, _ENTRY))
            self._forget(own)
            at = len(self.runs) - len(own)
            self.runs[at:], self.levels[at:] = [new], [max(self.levels[at:]) + 1]

    def _forget(self, runs: list[str]) -> None:
        discard(self.spark, *(f"{run}/kind=1" for run in runs))

    def drop(self) -> None:
        """Delete the fingerprints; answers stay."""
        self._forget(self.runs)
        self.runs, self.levels = [], []

    def close(self) -> None:
        """Take the tables out of the catalog; their files stay."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE {name}")
        self.tables = {}


def entries_of(chunks: DataFrame, ranges: int) -> DataFrame:
    """Rows (part, chunk, h, v, first) for FingerprintIndex.add: the windows of each chunk."""

    def send(batches):
        for c in ck.each(batches):
            e = Entries(c)
            rows = [(p, *_encoded(e.h[a:b], e.v[a:b], e.first[a:b])) for p, a, b in ck.blocks(e.h, ranges)]
            if rows:
                own, *blobs = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([c.number] * len(rows)), *(pa.array(x, pa.binary()) for x in blobs)], ["part", "chunk", "h", "v", "first"])

    return chunks.mapInArrow(tk.lean(send), "part int, chunk long, h binary, v binary, first binary")


def _flags(c: ck.Chunk, e: Entries, ranges: int) -> np.ndarray:
    """The answer for each entry."""
    sent = {part: v for _, part, v in c.back}
    out = np.zeros(len(e.h), bool)
    for p, a, b in ck.blocks(e.h, ranges):
        out[a:b] = np.unpackbits(np.frombuffer(sent[p], np.uint8), count=b - a)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, keep_text: bool = True, index: str | None = None) -> DataFrame:
    """Rows (key, n_words, n_removed, kept_sha256[, kept_text, removed]), one for each row of docs.

    Removes each word covered by a window of 13 words that also starts in a document with a smaller key, judged on the input.
    Documents enter the index in `batches` ranges of the key. index: a folder that all executors see; documents of earlier calls with it count as well, and
    it is kept (made if there is none) and holds those of docs afterwards. Without one, the fingerprints are deleted at the end.
    removed: (start, end) in words. A null text has no words; a null key comes after all others, and equal keys don't count as smaller. Keys are whole
    numbers (others are cast). Texts of any length are whole; a longer one than a chunk (CHUNK_BYTES) is a chunk of its own. Other columns are ignored.
    """
    spark = docs.sparkSession
    number = F.lit(0)
    if batches > 1:
        for edge in docs.select(docs[key].cast("double").alias("k")).approxQuantile("k", [i / batches for i in range(1, batches)], 0.02):
            number = number + F.coalesce((docs[key] > edge).cast("int"), F.lit(1))
    chunks, _ = ck.pack(docs, key, text, number)
    if index and ck.exists(spark, f"{index}/manifest"):
        log = FingerprintIndex.open(spark, index)
    else:
        log = FingerprintIndex(spark, index or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", RANGES * parts(docs))
    ranges, flags = log.ranges, None
    for b in range(batches):
        found = log.add(entries_of(chunks.where(F.col("batch") == b), ranges))
        flags = found if flags is None else flags.union(found)
        free_shuffles(spark)
    if index:
        log.save()
        flags, _ = materialize(flags, "flags")  # later calls may compact, and delete, the tables that hold them
    else:
        log.drop()
    log.close()

    def finish(batches_):
        names = ["key", "n_words", "n_removed", "kept_sha256"] + ["kept_text", "removed"] * keep_text
        for c in ck.each(batches_):
            e = Entries(c)
            w = e.words
            gone = np.zeros(len(w.start), bool)
            if len(e.at):
                hit = _flags(c, e, ranges)[e.entry] | (e.first[e.entry] < c.ids[w.doc[e.at]])
                gone = tk.covered(e.at[hit], WINDOW, len(gone))
            removed = tk.per_text(gone, w.cut)
            data = c.raw.tobytes()
            texts = []
            for i, (a, b) in enumerate(zip(c.off[:-1].tolist(), c.off[1:].tolist())):
                own = data[a:b].split()
                if removed[i]:
                    own = compress(own, (~gone[w.cut[i] : w.cut[i + 1]]).tolist())
                texts.append(b" ".join(own))
            cols = [c.key_column(), pa.array(w.count), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            if keep_text:
                cols += [pa.array([t.decode() for t in texts], pa.string()), _spans(gone, w)]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "key long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, removed array<struct<start:long,end:long>>" * keep_text
    return ck.answered(chunks, flags).mapInArrow(tk.lean(finish), schema).withColumnRenamed("key", key)


def _spans(gone: np.ndarray, w: tk.Words) -> pa.Array:
    step = np.zeros(len(gone), bool)
    stop = np.zeros(len(gone), bool)
    if len(gone):
        first, last = np.ones(len(gone), bool), np.ones(len(gone), bool)
        first[1:] = w.doc[1:] != w.doc[:-1]
        last[:-1] = first[1:]
        step = gone.copy()
        step[1:] &= ~gone[:-1] | first[1:]
        stop = gone.copy()
        stop[:-1] &= ~gone[1:] | last[:-1]
    start, end = np.flatnonzero(step), np.flatnonzero(stop)
    base = w.cut[w.doc[start]] if len(start) else np.zeros(0, np.int64)
    items = pa.StructArray.from_arrays([pa.array((start - base).astype(np.int64)), pa.array((end + 1 - base).astype(np.int64))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, w.cut).astype(np.int32)), items)
