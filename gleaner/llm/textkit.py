"""Whole batches of texts as bytes: words, hashes and windows by numpy, without a loop over rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

#: The bytes that end a word.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SLICE_BYTES = 1 << 20

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept and grown by doubling."""
    have = _powers.get(base, np.ones(1, _U))
    while len(have) < n:
        have = np.concatenate([have, have * _U(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice has at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = offsets_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def offsets_of(arr: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    raw = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)
    return raw[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each text starts (one more at the end). A null is an empty text."""
    if arr.null_count:
        arr = pa.concat_arrays([arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")])
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = offsets_of(arr)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lean(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, which gives the memory that a task has used back to the system, as Python workers live on for later tasks."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return unused memory to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


class Words:
    """The words of a slice: where they start and end, the text each one is in, and how many each text has."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        inside = ~_IS_SPACE[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = off[:-1][np.diff(off) > 0]
        first[edge] = inside[edge]
        edge = off[1:][np.diff(off) > 0] - 1
        last[edge] = inside[edge]
        self.raw, self.off = raw, off
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.cut = np.searchsorted(self.start, off)
        self.count = np.diff(self.cut)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def hashes(self, raw: np.ndarray | None = None, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; raw: the bytes to take instead, such as lower-cased ones; family: 0 or 1, independent hashes."""
        return spans(self.raw if raw is None else raw, self.start, self.end, family)


_PLACE = (0xA24BAED4963EE407, 0x8EBC6AF09C88C6E3)
#: Bytes that are hashed at once, so that they stay in a core's cache.
_SPAN_BLOCK = 1 << 15


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each pair; pairs may overlap.

    Each byte is mixed together with its place in the span before it is summed up, so that no arithmetic relation between bytes and places
    carries over to the sums. The two families have tables and constants of their own: both together are a 128-bit hash.
    """
    size = (end - start).astype(np.int64)
    out = np.zeros(len(size), _U)
    value, place = _BYTE_VALUE[family], _U(_PLACE[family])
    reach = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _SPAN_BLOCK, "right")))
        own = size[at:to]
        head = np.cumsum(own) - own
        total = int(own.sum())
        if total == own[0] and total > _SPAN_BLOCK:  # one long span
            for i in range(0, total, _SPAN_BLOCK):
                part = raw[start[at] + i : min(start[at] + i + _SPAN_BLOCK, end[at])]
                out[at : at + 1] += mix(value[part] + np.arange(i, i + len(part), dtype=_U) * place).sum(dtype=_U)
        elif total:
            where = np.arange(total) - np.repeat(head, own)
            x = value[raw[where + np.repeat(start[at:to], own)]]
            x += where.astype(_U) * place
            sums = np.zeros(total + 1, _U)
            np.cumsum(mix(x), out=sums[1:])
            out[at:to] = sums[head + own] - sums[head]
        at = to
    return mix(out + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of raw[i:i+k] for each i; mix() it before its low bits are used."""
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE_VALUE[0][raw] * powers(_BASE, len(raw)), out=total[1:])
    out = total[k:] - total[:-k]
    out *= powers(_BASE_INV, len(raw) + 1)[: len(out)]
    return out


def least_rolling(raw: np.ndarray, k: int, w: int, block: int = 1 << 16) -> np.ndarray:
    """sliding_min(rolling(raw, k), w), made in blocks that stay in a core's cache."""
    n = len(raw) - k - w + 2
    if n <= 0:
        return np.zeros(0, _U)
    out = np.empty(n, _U)
    for a in range(0, n, block):
        b = min(n, a + block)
        out[a:b] = sliding_min(rolling(raw[a : b + k + w - 2], k), w)
    return out


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    upper = (raw >= 65) & (raw <= 90)
    return raw + (upper.astype(np.uint8) << 5)


def windows(hashes: np.ndarray, k: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of hashes[i:i+k] for each i; it also crosses the borders of texts, which inside() tells apart."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j in range(k):
        out = out * _U(base) + hashes[j : j + n]
    return mix(out)


def inside(doc: np.ndarray, k: int) -> np.ndarray:
    """Whether the window of k items that starts at i stays in one text."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n items lie in a window of k items that starts at one of starts."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + k, n), -1)
    return np.cumsum(step[:n]) > 0


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for each i."""
    if len(x) < w:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


def per_text(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive cuts."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[cut[1:]] - total[cut[:-1]]


def batch(names: list[str], columns: list, schema: pa.Schema | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
