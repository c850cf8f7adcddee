"""Suffixes of a shard in order, with common prefixes, by external induced sorting to a bounded depth.

The leftmost suffixes of ascending runs (S*) are ranked first; the others follow by induction: scanning suffixes in order puts
each one's left neighbour into the queue of its first byte, L suffixes upwards, then S suffixes downwards. The queues,
one for each first byte, form a monotone priority queue; they carry tuples (position, common prefix with the one before)
in blocks and spill to scratch files. Only `depth` bytes of a suffix matter here, so the recursion on the string of S* names ends
at its first level: their ranks are settled by the bytes themselves, deep enough for any match, in sorted runs on disk that are merged bucket by bucket.

Besides the text and a byte a symbol for its type, both of which may be mapped from scratch files, a sort holds a few blocks and queue ends.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples of a queue that stay in memory, and of a block that is worked on at once.
IN_MEMORY = 1 << 21
BLOCK = 1 << 18
#: S* suffixes of a sorted run, and symbols of the text that are looked at at once.
RUN = 1 << 18
STEP = 1 << 21
#: Arrays from so many bytes on are mapped from a scratch file.
MAPPED = 32 << 20
_TUPLE = np.dtype([("pos", np.int64), ("lcp", np.uint8)])


def scratch(n: int, dtype) -> np.ndarray:
    """n zeros; a large array lies in a scratch file, which vanishes with the task, and the system keeps as much of it in memory as there is room for."""
    dtype = np.dtype(dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,)) if n * dtype.itemsize >= MAPPED else np.zeros(n, dtype)


class Spill:
    """One scratch file for all queues of a sort, which vanishes with the task, as Spark's own spills do."""

    def __init__(self) -> None:
        self.file = None

    def write(self, data: bytes) -> int:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(data)
        return at

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)


class Queue:
    """Tuples in the order they came; all but the newest go to the scratch file."""

    def __init__(self, in_memory: int, spill: Spill):
        self.in_memory, self.blocks, self.held, self.spill, self.spilled = in_memory, [], 0, spill, []

    def append(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        self.blocks.append((pos, lcp))
        self.held += len(pos)
        if self.held > self.in_memory:
            pos, lcp = self._join()
            block = np.empty(len(pos), _TUPLE)
            block["pos"], block["lcp"] = pos, lcp
            self.spilled.append((self.spill.write(block.tobytes()), len(block)))
            self.blocks, self.held = [], 0

    def _join(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([b[0] for b in self.blocks]), np.concatenate([b[1] for b in self.blocks])

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What has come so far, oldest first; the queue is then empty."""
        spilled, blocks = self.spilled, self.blocks
        self.spilled, self.blocks, self.held = [], [], 0
        for at, n in spilled:
            for a in range(0, n, BLOCK):
                block = np.frombuffer(self.spill.read(at + a * _TUPLE.itemsize, min(BLOCK, n - a) * _TUPLE.itemsize), _TUPLE)
                yield block["pos"], block["lcp"]
        if blocks:
            pos, lcp = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
            for a in range(0, len(pos), BLOCK):
                yield pos[a : a + BLOCK], lcp[a : a + BLOCK]

    def backwards(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples from the newest to the oldest; they stay."""
        pieces = [(at + a * _TUPLE.itemsize, min(BLOCK, n - a)) for at, n in self.spilled for a in range(0, n, BLOCK)]
        if self.blocks:
            pos, lcp = self._join()
            yield pos[::-1], lcp[::-1]
        for at, n in reversed(pieces):
            block = np.frombuffer(self.spill.read(at, n * _TUPLE.itemsize), _TUPLE)
            yield block["pos"][::-1], block["lcp"][::-1]


def is_s_type(text: np.ndarray, step: int = STEP) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one, a separator, counts as such. Worked out from the end, some symbols at once."""
    n = len(text)
    out = scratch(n, bool)
    out[n - 1] = True
    for b in range(n - 1, 0, -step):
        a = max(0, b - step)
        sign = np.sign(text[a + 1 : b + 1].astype(np.int16) - text[a:b].astype(np.int16)).astype(np.int8)
        where = np.where(sign != 0, np.arange(b - a), b - a)
        nearest = np.minimum.accumulate(where[::-1])[::-1]
        out[a:b] = np.append(sign, 1 if out[b] else -1)[nearest] > 0
    return out


def _star_blocks(text: np.ndarray, s_type: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Positions of S* suffixes, separators included, in blocks."""
    for a in range(0, len(text), step):
        b = min(a + step, len(text))
        star = s_type[a:b].copy()
        star[1:] &= ~s_type[a : b - 1]
        star[0] &= a > 0 and not s_type[a - 1]
        at = a + np.flatnonzero(star)
        if len(at):
            yield at


def _enough(text: np.ndarray, s_type: np.ndarray, last: np.ndarray | None, ends: np.ndarray, step: int) -> np.ndarray:
    """For each string the first S* position after its last wanted one: a suffix is induced from the next S* suffix, so no later one is needed."""
    out = ends.copy()
    if last is not None:
        for at in _star_blocks(text, s_type, step):
            own = slice(np.searchsorted(ends, at[0]), np.searchsorted(last, at[-1]))
            out[own] = np.minimum(out[own], at[np.searchsorted(at, last[own], "right")])
    return out


class _Runs:
    """Sorted runs of (words, position) rows: one stays in memory, more go to a scratch file; merged() gives all rows in order, in blocks."""

    def __init__(self, width: int, size: int):
        self.kind = np.dtype([("words", np.uint64, (width,)), ("pos", np.int64)])
        self.size, self.file, self.runs, self.only, self.sample = size, None, [], None, []

    def add(self, rows: np.ndarray) -> None:
        if self.only is None and not self.runs:
            self.only = rows
            return
        for own in (self.only, rows):
            if own is not None:
                self.file = self.file or tempfile.TemporaryFile()
                self.file.seek(0, 2)
                self.runs.append((self.file.tell(), len(own)))
                self.file.write(own.tobytes())
                self.sample.append(own["words"][:: max(1, self.size // 64)].copy())
        self.only = None

    def _read(self, run: tuple[int, int], lo: int, hi: int) -> np.ndarray:
        self.file.seek(run[0] + lo * self.kind.itemsize)
        return np.frombuffer(self.file.read((hi - lo) * self.kind.itemsize), self.kind)

    def _before(self, run: tuple[int, int], key: np.ndarray) -> int:
        """How many rows of a run are smaller than key, by halving."""
        lo, hi = 0, run[1]
        while lo < hi:
            mid = (lo + hi) // 2
            row = self._read(run, mid, mid + 1)["words"][0]
            unlike = np.flatnonzero(row != key)
            if len(unlike) and row[unlike[0]] < key[unlike[0]]:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def merged(self) -> Iterator[np.ndarray]:
        if self.only is not None:
            yield self.only
            return
        if not self.runs:
            return
        sample = np.concatenate(self.sample)
        sample = sample[np.lexsort(sample.T[::-1])]
        total = sum(n for _, n in self.runs)
        marks = sample[:: max(1, len(sample) * self.size // max(total, 1))][1:]
        new = np.ones(len(marks), bool)
        new[1:] = (marks[1:] != marks[:-1]).any(1)
        at = [0] * len(self.runs)
        for key in [*marks[new], None]:
            to = [run[1] if key is None else self._before(run, key) for run in self.runs]
            rows = [self._read(run, a, b) for run, a, b in zip(self.runs, at, to) if b > a]
            at = to
            if rows:
                rows = np.concatenate(rows)
                yield rows[_sorted(rows["words"])]


def _words(text: np.ndarray, at: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """The first `depth` symbols, or `size` if that is less, from each position on, as big-endian 8-byte words (rows)."""
    n, lo, hi = (depth + 7) // 8, int(at.min()), int(at.max()) + 1
    padded = np.zeros(hi - lo + 8 * n, text.dtype)
    own = text[lo : hi + 8 * n]
    padded[: len(own)] = own
    view = np.lib.stride_tricks.as_strided(padded, (hi - lo, 8 * n), (padded.strides[0], padded.strides[0]))
    words = view[at - lo].view(">u8").astype(np.uint64)
    for j in range(n):
        left = np.clip(size - 8 * j, 0, 8).astype(np.uint64)
        cut = left < 8
        words[cut, j] &= np.where(left[cut] > 0, ~np.uint64(0) << (np.uint64(64) - np.maximum(left[cut], np.uint64(1)) * np.uint64(8)), np.uint64(0))
    return words


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Order of distinct rows of words: by the first word, and then only what is still tied by the next."""
    order = np.argsort(rows[:, 0])
    first = rows[order, 0]
    group = np.cumsum(np.append(False, first[1:] != first[:-1]))
    for j in range(1, rows.shape[1]):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        own = order[tied]
        again = np.lexsort((rows[own, j], group[tied]))
        order[tied] = own[again]
        value = rows[order[tied], j]
        new = np.zeros(len(order), bool)
        new[1:] = group[1:] != group[:-1]
        new[tied[1:]] |= value[1:] != value[:-1]
        group = np.cumsum(new)
    return order


def _common(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many leading bytes the rows of a and b share, zeros (separators) not counted."""
    out = np.full(len(a), 8 * a.shape[1], np.int64)
    open_ = np.arange(len(a))
    for j in range(a.shape[1]):
        x = a[open_, j] ^ b[open_, j]
        x |= np.where(a[open_, j] & np.uint64(255) == 0, np.uint64(1), np.uint64(0))  # the end of a cut suffix
        done = x != 0
        both, own = a[open_[done], j], x[done]
        zeros = 64 - np.frexp(own.astype(np.float64))[1]  # at most one too many near a power of two, so checked below
        same = np.clip(zeros, 0, 63) // 8
        same = np.where((own >> (np.uint64(56) - np.minimum(same, 7).astype(np.uint64) * np.uint64(8))) > 255, same - 1, same)
        for q in range(7, -1, -1):  # separators end what is shared
            same = np.where((both >> np.uint64(56 - 8 * q)) & np.uint64(255) == 0, np.minimum(same, q), same)
        out[open_[done]] = 8 * j + same
        open_ = open_[~done]
    return np.minimum(out, depth).astype(np.uint8)


class _Minima:
    """Minimum of lcp over any range of a block, by a table of powers of two."""

    def __init__(self, lcp: np.ndarray):
        self.rows = [lcp]
        span = 1
        while span * 2 <= len(lcp):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """lo <= hi, both included."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.uint8)
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k)) + 1])
        return out


class _Induction:
    """Puts the left neighbours of scanned suffixes into the queues of their first symbols."""

    def __init__(self, text: np.ndarray, s_type: np.ndarray, want: bool, depth: int, in_memory: int, spill: Spill):
        self.text, self.s_type, self.want, self.depth, self.spill = text, s_type, want, depth, spill
        self.queues: dict[int, Queue] = {}
        self.in_memory = in_memory
        self.since = np.zeros(256, np.uint8)  # least common prefix since a queue's last tuple
        self.fresh = np.ones(256, bool)

    def scan(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        before = pos - 1
        go = np.flatnonzero((pos > 0) & (self.s_type[before] == self.want) & (self.text[before] != 0))
        least = lcp.min()
        if len(go):
            symbol = self.text[before[go]]
            order = np.argsort(symbol, kind="stable")
            go, symbol = go[order], symbol[order]
            head = np.ones(len(go), bool)
            head[1:] = symbol[1:] != symbol[:-1]
            lo = np.zeros(len(go), np.int64)
            lo[1:] = go[:-1] + 1
            lo[head] = 0
            table = _Minima(lcp)
            value = table.over(lo, go)
            first = np.flatnonzero(head)
            old = symbol[first]
            value[first] = np.minimum(value[first], self.since[old])
            new = np.minimum(value.astype(np.int16) + 1, self.depth).astype(np.uint8)
            new[first[self.fresh[old]]] = 0  # nothing before it in its queue
            cut = np.append(first, len(go))
            self.since = np.minimum(self.since, least)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                s = int(symbol[a])
                if s not in self.queues:
                    self.queues[s] = Queue(self.in_memory, self.spill)
                self.queues[s].append(before[go[a:b]], new[a:b])
                last = go[b - 1] + 1
                self.since[s] = lcp[last:].min() if last < len(lcp) else 255
                self.fresh[s] = False
        else:
            self.since = np.minimum(self.since, least)


def _ranked(text: np.ndarray, s_type: np.ndarray, depth: int, enough: np.ndarray, ends: np.ndarray, in_memory: int, spill: Spill, run: int, step: int) -> dict[int, Queue]:
    """The S* suffixes in ascending order, with common prefixes, in a queue for each first symbol."""
    width = (depth + 7) // 8
    runs, held, n = _Runs(width, run), [], 0

    def flush() -> None:
        at = np.concatenate(held)
        for a in range(0, len(at), run):
            own = at[a : a + run]
            rows = np.empty(len(own), runs.kind)
            words = _words(text, own, np.minimum(ends[np.searchsorted(ends, own)] - own, depth), depth)
            order = _sorted(words)
            rows["words"], rows["pos"] = words[order], own[order]
            runs.add(rows)

    for at in _star_blocks(text, s_type, step):
        at = at[text[at] != 0]
        at = at[at <= enough[np.searchsorted(ends, at)]]
        if not len(at):
            continue
        held.append(at)
        n += len(at)
        if n >= run:
            flush()
            held, n = [], 0
    if n:
        flush()
    out: dict[int, Queue] = {}
    before = None
    for rows in runs.merged():
        words, pos = rows["words"], rows["pos"]
        lcp = np.zeros(len(pos), np.uint8)
        lcp[1:] = _common(words[1:], words[:-1], depth)
        if before is not None:
            lcp[:1] = _common(words[:1], before, depth)
        before = words[-1:].copy()
        symbol = text[pos]
        head = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        for a, b in zip(head, [*head[1:], len(pos)]):
            out.setdefault(int(symbol[a]), Queue(in_memory, spill)).append(pos[a:b].copy(), lcp[a:b].copy())
    return out


def suffixes(
    text: np.ndarray, depth: int, last: np.ndarray | None = None, in_memory: int = IN_MEMORY, run: int = RUN, step: int = STEP
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, common) of suffixes that don't start at a separator, in descending order.

    text: uint8 symbols, 0 only as a separator, which ends it and counts as unlike any other. common: the bytes a suffix
    shares with the one before it in this order, `depth` at most. Suffixes alike in `depth` bytes come in any order.
    last: for each string between separators the last position whose suffix is wanted; suffixes after it that no wanted one
    is induced from are left out. All are wanted by default. in_memory: tuples of a queue before it spills; run: suffixes of a sorted run; step: symbols looked at at once.
    """
    s_type = is_s_type(text, step)
    ends = np.concatenate([a + np.flatnonzero(text[a : a + step] == 0) for a in range(0, len(text), step)])
    enough = _enough(text, s_type, last, ends, step)
    spill = Spill()
    stars = _ranked(text, s_type, depth, enough, ends, in_memory, spill, run, step)
    first = ends[enough == ends]  # separators are smaller than all else

    up = _Induction(text, s_type, False, depth, in_memory, spill)
    kept: dict[int, Queue] = {}
    for a in range(0, len(first), BLOCK):
        up.scan(first[a : a + BLOCK], np.zeros(len(first[a : a + BLOCK]), np.uint8))
    seen = np.zeros(256, bool)
    for a in range(0, len(text), step):
        seen[np.unique(text[a : a + step])] = True
    symbols = np.flatnonzero(seen[1:]) + 1
    for c in symbols.tolist():
        keep = kept[c] = Queue(in_memory, spill)
        prior = None
        while c in up.queues and (up.queues[c].blocks or up.queues[c].spilled):
            for pos, l in up.queues[c].take():
                if prior is None:
                    l = l.copy()
                    l[0] = 0
                keep.append(pos, l)
                prior = pos[-1]
                up.scan(pos, l)
        begins = True
        for pos, l in stars[c].take() if c in stars else ():
            l = l.copy()
            if begins:
                l[0] = 0 if prior is None else min(_run_at(text, prior, depth), _run_at(text, pos[0], depth))
            begins = False
            up.scan(pos, l)

    down = _Induction(text, s_type, True, depth, in_memory, spill)
    for c in symbols[::-1].tolist():
        prior = None
        while c in down.queues and (down.queues[c].blocks or down.queues[c].spilled):
            for pos, l in down.queues[c].take():
                if prior is None:
                    l = l.copy()
                    l[0] = 0
                prior = pos[-1]
                down.scan(pos, l)
                yield pos, l
        carry = None  # going backwards, a tuple's common prefix belongs to the next one
        for pos, l in kept[c].backwards():
            shifted = np.empty_like(l)
            shifted[1:] = l[:-1]
            shifted[0] = (0 if prior is None else min(_run_at(text, prior, depth), _run_at(text, pos[0], depth))) if carry is None else carry
            carry = l[-1]
            down.scan(pos, shifted)
            yield pos, shifted
        kept.pop(c)


def _run_at(text: np.ndarray, at: int, most: int) -> int:
    """How often the symbol at a position repeats from there on, `most` at most."""
    unlike = text[at : at + most] != text[at]
    return int(unlike.argmax()) if unlike.any() else most
