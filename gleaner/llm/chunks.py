"""Documents packed into chunks, and which hashed keys of a chunk other documents share.

A chunk is a row with about a megabyte of whole texts. Operators that compare passages of all documents work on
chunks: keys are hashed and counted once a chunk before they are shuffled, as sorted binary blocks split by hash range, and
the answer that comes back is a byte a key. No task gets more of a frequent key than one entry a chunk.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textkit as tk
from gleaner.llm.common import discard, free_shuffles, parts, shared_folder

CHUNK_BYTES = 2 << 20
#: Where a null doc_id stands in the order: after all others.
LAST = np.int64((1 << 63) - 1)


@dataclass
class Chunk:
    """ids: a number a text, LAST for null; known: whether the id is not null; raw, off: the bytes; row: the carried columns, if any."""

    number: int
    ids: np.ndarray
    known: np.ndarray
    raw: np.ndarray
    off: np.ndarray
    back: list
    row: pa.Array | None = None

    def key_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=~self.known)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", batch=None, size: int = CHUNK_BYTES, carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """Write docs as a table of chunks (chunk, batch, ids, known, off, data, row) in the shared folder, without a shuffle.

    The table is bucketed by chunk, so that what comes back for the chunks is joined without shuffling texts again. Returns it and its folder.

    batch: an integer column; a chunk holds rows of one batch. carry: columns that go along, as an Arrow stream.
    The rows of a task that don't fill a chunk make a smaller one.
    """
    rows = docs.select(
        docs[key].cast("long").alias("key"), docs[text].alias("text"), (F.lit(0) if batch is None else batch).cast("int").alias("batch"),
        *([F.struct(*(docs[c] for c in carry)).alias("row")] if carry else []),
    )

    def run(batches):
        held: dict[int, list] = {}
        names = ["batch", "ids", "known", "off", "data", "row"]

        def flush(number):
            *arrays, row = zip(*held.pop(number))
            ids, known, sizes, data = (np.concatenate(x) for x in arrays)
            stream = None
            if carry:
                table = pa.Table.from_arrays([pa.chunked_array(row)], ["row"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                stream = sink.getvalue().to_pybytes()
            off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            values = [ids.astype(np.int64).tobytes(), known.astype(np.uint8).tobytes(), off.tobytes(), data.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([v], pa.binary()) for v in [*values, stream])], names)

        for part in tk.slices(batches, limit=size // 2):
            key_ = part.column("key")
            ids = key_.fill_null(int(LAST)).to_numpy(zero_copy_only=False)
            known = key_.is_valid().to_numpy(zero_copy_only=False)
            raw, off = tk.bytes_of(part.column("text"))
            number = part.column("batch").fill_null(0).to_numpy(zero_copy_only=False)
            for b in np.unique(number).tolist():
                mine = number == b
                data = raw if mine.all() else raw[np.repeat(mine, np.diff(off))]
                row = part.column("row").filter(pa.array(mine)) if carry else None
                held.setdefault(b, []).append((ids[mine], known[mine], np.diff(off)[mine], data.copy(), row))
                if sum(len(x[3]) for x in held[b]) >= size // 2:
                    yield flush(b)
        for b in list(held):
            yield flush(b)

    packed = rows.mapInArrow(tk.lean(run), "batch int, ids binary, known binary, off binary, data binary, row binary").withColumn("chunk", F.monotonically_increasing_id())
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    packed.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(parts(docs), "chunk").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and out knows them and their buckets
    return out, path


def exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def release(spark, path: str) -> None:
    """Delete the chunks that `pack` wrote."""
    discard(spark, path)
    free_shuffles(spark)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """The chunks in record batches; back: what `answered` has joined, as (kind, part, bytes) in order."""
    for b in batches:
        back = b.column("back") if "back" in b.schema.names else None
        for i in range(b.num_rows):
            get = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: B023, E731
            got = [] if back is None or not back[i].is_valid else sorted((x["kind"], x["part"], x["value"]) for x in back[i].as_py())
            row = b.column("row")[i]
            row = pa.ipc.open_stream(row.as_buffer()).read_all().column("row").combine_chunks() if row.is_valid else None
            yield Chunk(b.column("chunk")[i].as_py(), get("ids", np.int64), get("known", np.uint8).astype(bool), get("data", np.uint8), get("off", np.int64), got, row)


def packed(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as their least and the differences to it, byte plane by byte plane, without planes of zeros above."""
    low = x.min() if len(x) else np.uint64(0)
    rest = x - low
    planes = (int(rest.max(initial=0)).bit_length() + 7) // 8
    return struct.pack("<QQB", len(x), int(low), planes) + np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpacked(data) -> np.ndarray:
    n, low, planes = struct.unpack_from("<QQB", data)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :planes] = np.frombuffer(data, np.uint8, n * planes, 17).reshape(planes, n).T
    return wide.view(np.uint64).ravel() + np.uint64(low)


def packed_size(data) -> int:
    """Bytes of the packed numbers at the beginning of data."""
    n, _, planes = struct.unpack_from("<QQB", data)
    return 17 + n * planes


def sorted_packed(h: np.ndarray) -> bytes:
    """Ascending numbers as packed steps."""
    return packed(np.diff(h, prepend=np.uint64(0)))


def sorted_unpacked(data) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Hash range of each key; sorted keys have sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and in how many texts each one is; owner: the text of each key, in ascending order."""
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    other = new.copy()
    other[1:] |= o[1:] != o[:-1]
    head = np.flatnonzero(new)
    return k[head], (np.add.reduceat(other.astype(np.int64), head) if len(head) else np.zeros(0, np.int64))


def blocks(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys, for parts that have any."""
    cut = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, int(cut[p]), int(cut[p + 1])


def grouped(batches: Iterator[pa.RecordBatch], column: str = "part") -> Iterator[list[dict]]:
    """Rows that follow each other with the same value of column, as lists of dicts with buffers for binaries."""
    now, rows = None, []
    for b in batches:
        names = b.schema.names
        cols = [b.column(n) for n in names]
        for i in range(b.num_rows):
            row = {n: (c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py()) for n, c in zip(names, cols)}
            if rows and row[column] != now:
                yield rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield rows


def gather(rows: DataFrame, parts: int) -> DataFrame:
    """Bring the rows of each part together, one part after another in a task."""
    return rows.repartition(parts, "part").sortWithinPartitions("part")


#: What makes the keys of a chunk: the keys and the text each is in, in ascending order of texts.
KeyMaker = Callable[[Chunk], tuple[np.ndarray, np.ndarray]]


def level(count: np.ndarray) -> np.ndarray:
    """A count in a byte: itself below 192, and then four steps for each doubling."""
    far = 192 + np.floor(4 * np.log2(np.maximum(count, 192) / 192)).astype(np.int64)
    return np.where(count < 192, count, np.minimum(far, 255)).astype(np.uint8)


def count_shared(chunks: DataFrame, keys: KeyMaker, parts: int) -> DataFrame:
    """Rows (chunk, part, value): for each distinct key of the chunk, in order, the level() of how many documents it is in.

    40 bits of a key are compared within its hash range, so that a key is seldom counted with another; counts are only ever
    too high, and serve to leave out what nothing else shares.
    """

    def send(batches):
        for c in each(batches):
            k, n = distinct(*keys(c))
            low = np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
            few = np.minimum(n, 255).astype(np.uint8).tobytes()
            rows = [(p, low[5 * a : 5 * b], few[a:b]) for p, a, b in blocks(k, parts)]
            if rows:
                own, lows, counts = zip(*rows)
                yield tk.batch(["part", "chunk", "low", "n"], [pa.array(own, pa.int32()), pa.array([c.number] * len(rows)), pa.array(lows, pa.binary()), pa.array(counts, pa.binary())])

    def count(batches):
        for rows in grouped(batches):
            lows = [np.frombuffer(r["low"], np.uint8).reshape(-1, 5) for r in rows]
            wide = np.zeros((sum(map(len, lows)), 8), np.uint8)
            np.concatenate(lows, out=wide[:, :5])
            key = wide.view(np.uint64).ravel()
            n = np.concatenate([np.frombuffer(r["n"], np.uint8) for r in rows]).astype(np.int64)
            order = np.argsort(key)
            s = key[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            total = np.add.reduceat(n[order], np.flatnonzero(new))
            value = np.empty(len(s), np.uint8)
            value[order] = level(total)[np.cumsum(new) - 1]
            cut = np.cumsum([0] + [len(x) for x in lows])
            yield tk.batch(
                ["chunk", "part", "value"],
                [pa.array([r["chunk"] for r in rows]), pa.array([r["part"] for r in rows], pa.int32()), pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
            )

    sent = chunks.mapInArrow(tk.lean(send), "part int, chunk long, low binary, n binary")
    return gather(sent, parts).mapInArrow(tk.lean(count), "chunk long, part int, value binary")


def answered(chunks: DataFrame, *values: DataFrame) -> DataFrame:
    """chunks with a column `back`: the (part, value) rows of each of values for each chunk, which number at most its keys."""
    rows = None
    for kind, v in enumerate(values):
        own = v.select("chunk", F.lit(kind).alias("kind"), "part", "value")
        rows = own if rows is None else rows.union(own)
    back = rows.groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "value")).alias("back"))
    return chunks.join(back.hint("shuffle_hash"), "chunk", "left")


def values_of(chunk: Chunk, kind: int = 0) -> np.ndarray:
    """A byte for each key that the chunk sent, in the order of its keys."""
    return np.frombuffer(b"".join(v for k, _, v in chunk.back if k == kind), np.uint8)
