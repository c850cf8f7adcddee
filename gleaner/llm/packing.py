"""Best-fit packing of tokenized documents into sequences, after Martello and Toth's reduction by dominance.

Documents of one length are alike, so the instance is its histogram of lengths: as many numbers as a sequence has tokens, whatever the input. It is
reduced and packed on the driver, which gives intervals of like pieces and of like sequences; pieces are numbered by length and take their places by number.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textkit as tk
from gleaner.llm.common import discard, materialize
from gleaner.operators.table import row_numbers

CAPACITY = 4096
#: Bytes of words and tokens that a worker remembers.
REMEMBERED = 400 << 20
#: Signs of ASCII but the apostrophe, with which endings begin.
SIGNS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
_SIGNS = SIGNS.encode()
#: Lower-case letters a-z and from ß to ÿ, in UTF-8.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Words that go to the tokenizer as one text.
TOGETHER = 200
#: Bytes of a long text whose words are held as objects at once.
PIECE_BYTES = 1 << 20


class WordEncoder:
    """Token ids by a tokenizer that drops white space: the words of a text are encoded apart, and each word once while it is remembered."""

    def __init__(self, built: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(built)
        a, b, both = (self._ids(x) for x in ("we'll go", "x1 ", " we'll \n go\tx1\x0b "))
        if a + b != both:
            raise ValueError("the tokenizer's words hang on the white space around them")
        #: A sign that is one token, to stand between words that are encoded together.
        self.between, self.token = next(((x, self._ids(x)[0]) for x in "|~^" if len(self._ids(x)) == 1 and self._ids(f"a {x} b") == self._ids("a") + self._ids(x) + self._ids("b")), (None, None))
        #: Tokens of their own, which a word is searched for before anything else is done to it.
        own = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.own = re.compile(b"|".join(map(re.escape, own)) if own else b"(?!)").search
        #: Whether case doesn't matter, and whether signs behind a letter or digit are tokens of their own.
        self.folds = self._ids("KALO Z1É") == self._ids("kalo z1É")
        self.parts_signs = all(self._ids(f"{x}{y}{z}") == self._ids(x) + self._ids(y + z) for x in ("kalo", "lé", "7") for y in SIGNS for z in ("", y, "."))
        self.letters = self._for_letters(Tokenizer, built)
        self.forget()

    def _for_letters(self, kind: type, built: str):
        """The tokenizer for words of lower-case letters alone, without normalizing and searching for parts, which take most of its time; None if its ids differ."""
        how = json.loads(built)
        steps = how["pre_tokenizer"].get("pretokenizers", [how["pre_tokenizer"]])
        how["normalizer"], how["pre_tokenizer"] = None, {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(x for x in steps if x["type"] == "ByteLevel")]}
        own = kind.from_str(json.dumps(how))
        letters = [chr(i) for i in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
        tries = [x + y for x in letters for y in ("", "a", "é", x, "the", "rgß")] + [y + x for x in letters for y in ("don", "s", "ñandú")]
        same = all(own.encode(x, add_special_tokens=False).ids == self._ids(x) for x in [*tries, " ".join(tries), f"a {self.between} b"])
        return own if same else None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        #: The ids of words and of their parts, as little-endian 32-bit numbers; and those of the time before, where words that come again are found.
        self.known: dict[bytes, bytes] = {}
        self.part: dict[bytes, bytes] = {}
        self.before: tuple[dict, dict] = ({}, {})
        self.held = 0

    def _parts(self, w: bytes) -> tuple[bytes, ...]:
        """Parts of a word whose ids one after another are those of the word: signs at the end often vary where the word doesn't."""
        if self.own(w):
            return (w,)
        w = w.lower() if self.folds else w
        core = w.rstrip(_SIGNS) if self.parts_signs else w
        if 0 < len(core) < len(w) and (core[-1:].isalnum() or core[-2:-1] == b"\xc3" and core[-1] not in b"\x97\xb7"):  # ASCII, or a letter from À to ÿ
            return core, w[len(core) :]
        return (w,)

    def learn(self, words: set[bytes]) -> None:
        """Look up or encode words that aren't known; many at once, as a call costs more than a word, but for those that hold the sign between them."""
        known, part = self.before
        again = {w: known[w] for w in words if w in known}
        letters, split, plain, other = _LETTERS.fullmatch, [], [], []
        fresh = words.difference(again)
        for w in fresh:
            if letters(w):
                plain.append(w)
                split.append((w,))
            else:
                own = self._parts(w)
                (plain if letters(own[0]) else other).append(own[0])
                other += own[1:]
                split.append(own)
        for kind, tokenizer in ((plain, self.letters or self.tokenizer), (other, self.tokenizer)):
            new = set(kind).difference(self.part)
            old = [w for w in new if w in part]
            self.part.update((w, part[w]) for w in old)
            self._encode_parts(list(new.difference(old)), tokenizer)
            self.held += 200 * len(new)
        parts = self.part
        again.update((w, parts[x[0]] if len(x) == 1 else parts[x[0]] + parts[x[1]]) for w, x in zip(fresh, split))
        self.known.update(again)
        self.held += 240 * len(words)

    def _encode_parts(self, new: list[bytes], tokenizer) -> None:
        sign = None if self.between is None else self.between.encode()
        apart = [w for w in new if sign is None or sign in w]
        together = [w for w in new if sign is not None and sign not in w]
        groups = [together[i : i + TOGETHER] for i in range(0, len(together), TOGETHER)]
        for group, ids in zip(groups, self._batch([f" {self.between} ".join(w.decode() for w in g) for g in groups], tokenizer)):
            at = np.flatnonzero(ids == self.token)
            if len(at) != len(group) - 1:
                apart += group
                continue
            data = ids.tobytes()
            cut = [-4, *(4 * at).tolist(), len(data)]
            self.part.update((w, data[a + 4 : b]) for w, a, b in zip(group, cut, cut[1:]))
        self.part.update((w, ids.tobytes()) for w, ids in zip(apart, self._batch([w.decode() for w in apart])))

    def encode(self, data: bytes) -> bytes:
        """The ids of a text of any length, as little-endian 32-bit numbers."""
        out, at = [], 0
        while at < len(data):
            to = min(len(data), at + PIECE_BYTES)
            while to < len(data) and data[to] not in tk.SPACES:
                to += 1
            out += self._encode([data[at:to].split()])
            at = to
        return b"".join(out)

    def encode_all(self, data: bytes, off: list[int]) -> list[bytes]:
        """The ids of the texts that start at off."""
        if len(data) > 2 * PIECE_BYTES:
            return [self.encode(data[a:b]) for a, b in zip(off, off[1:])]
        return self._encode([data[a:b].split() for a, b in zip(off, off[1:])])

    def _encode(self, texts: list[list[bytes]]) -> list[bytes]:
        if self.held > REMEMBERED // 2:
            before = (self.known, self.part)
            self.forget()
            self.before = before
        new = set().union(*texts).difference(self.known)
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, t)) for t in texts]


_encoders: dict[int, WordEncoder] = {}


def _encoder(number: int, built: str) -> WordEncoder:
    """The encoder of this worker."""
    if number not in _encoders:
        _encoders.clear()
        _encoders[number] = WordEncoder(built)
    return _encoders[number]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32[, ids]): the tokens of each row of docs and `end`, cut where there are more than capacity.

    tokenizer: a file of the tokenizers library, which the driver reads, of a kind that drops white space. ids_crc32 is that of the
    ids as little-endian 32-bit numbers. A null or empty text has the end token alone. Repeated rows and null keys stay.
    """
    with open(tokenizer) as f:
        built = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((zlib.crc32(built.encode()), built))
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        encoder, last = _encoder(*sent.value), struct.pack("<I", end)
        for part in tk.slices(batches):
            raw, off = tk.bytes_of(part.column("text"))
            row, starts, found = [], [], []
            for i, ids in enumerate(encoder.encode_all(raw.tobytes(), off.tolist())):
                ids += last
                cuts = range(0, len(ids) // 4, capacity)
                row += [i] * len(cuts)
                starts += cuts
                found += [ids[4 * a : 4 * (a + capacity)] for a in cuts]
            cols = [part.column("key").take(pa.array(row)), pa.array([a // capacity for a in starts], pa.int32()), pa.array(starts, pa.int64())]
            cols += [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64())]
            if keep_ids:
                cut = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(np.frombuffer(b"".join(found), "<i4"))))
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(tk.lean(run), schema)


def _best_pair(sizes: np.ndarray, count: np.ndarray, room: int) -> int:
    """The largest sum of two items that fit in room, 0 if none do; sizes ascending."""
    at = np.searchsorted(sizes, room - sizes, "right") - 1  # the largest partner
    lone = (at >= 0) & (sizes[at] == sizes) & (count == 1)
    at = np.where(lone, at - 1, at)
    fits = at >= 0
    return int((sizes[fits] + sizes[at[fits]]).max(initial=0))


def _rival(sizes: np.ndarray, count: np.ndarray, room: int, top: int, low: int) -> bool:
    """Whether some two items x >= y that fit in room can't be put where one of top and one of low are: y > low, and x + y > top."""
    mine = np.flatnonzero(sizes > low)
    y = sizes[mine]
    at = np.searchsorted(sizes, room - y, "right") - 1
    fits = at >= 0
    y, n, at = y[fits], count[mine][fits], at[fits]
    x = sizes[at]
    return bool(((x >= y) & ((x > y) | (n > 1)) & (x + y > top)).any())


def dominating(count: dict[int, int], sizes: list[int], s: int, capacity: int) -> tuple[int, ...] | None:
    """Items of a sequence with an s that dominates all others with it: whatever stands with an s in an optimal packing can change places with these.

    sizes: those with a count, ascending. Sets of up to three are tried, as in Martello and Toth's procedure: s alone if nothing fits beside it; s and one that fills it up, or
    the largest that fits if no two do or none of those weigh more; s and the largest, and the largest beside both, if each pair that fits can be put in their places.
    """
    room = capacity - s
    top = bisect_right(sizes, room) - 1
    if top >= 0 and sizes[top] == s and count[s] == 1:
        top -= 1
    if top < 0:
        return (s,)
    t = sizes[top]
    if t == room:
        return (s, t)
    least: list[int] = []  # the three smallest others
    for x in sizes[:4]:
        least += [x] * min(3, count[x] - (x == s))
    least = least[:3]
    if len(least) < 2 or least[0] + least[1] > room:
        return (s, t)
    if len(least) == 3 and sum(least) <= room:
        return None
    size = np.array(sizes[: top + 1])
    n = np.array([count[x] - (x == s) for x in sizes[: top + 1]])
    size, n = size[n > 0], n[n > 0]
    if t >= _best_pair(size, n, room):
        return (s, t)
    rest = [x for x in (size[(size < t) | (n > 1)]).tolist() if x <= room - t]
    if rest and not _rival(size, n, room, t, rest[-1]):
        return (s, t, rest[-1])
    return None


class Plan:
    """Where pieces go: rows (length, first, last, sequence, per, offset) for like pieces first..last - 1 of a length, `per` in each sequence on from `sequence`."""

    def __init__(self, count: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {s: n for s, n in count.items() if n}
        self.taken: Counter[int] = Counter()
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = self.fixed = 0

    def put(self, s: int, n: int, sequence: int, per: int, offset: int) -> None:
        first = self.taken[s]
        self.rows.append((s, first, first + n, sequence, per, offset))
        self.taken[s] += n
        self.left[s] -= n
        if not self.left[s]:
            del self.left[s]

    def reduce(self) -> None:
        """Fix sets that dominate until none is left; what stays is a smaller instance with the same optimum above what is fixed."""
        changed = True
        while changed:
            changed = False
            sizes = sorted(self.left)
            for s in reversed(sizes):
                while s in self.left and (own := dominating(self.left, sizes, s, self.capacity)):
                    need = Counter(own)
                    n = min(self.left[x] // k for x, k in need.items())
                    offset = 0
                    for x, k in need.items():
                        self.put(x, n * k, self.sequences, k, offset)
                        offset += x * k
                        if x not in self.left:
                            sizes.pop(bisect_left(sizes, x))
                    self.sequences += n
                    self.fixed += n
                    changed = True

    def best_fit(self) -> None:
        """The rest, longest first, each where the least room is left that holds it; like sequences are dealt with at once."""
        rooms: dict[int, list[tuple[int, int]]] = {}  # (first, number) of open sequences by their room
        known: list[int] = []
        for s in sorted(self.left, reverse=True):
            while s in self.left:
                n, at = self.left[s], bisect_left(known, s)
                if at < len(known):
                    room = known[at]
                    first, many = rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        known.pop(at)
                else:
                    room, first, many = self.capacity, self.sequences, -(-n // (self.capacity // s))
                    self.sequences += many
                per = room // s
                full = min(many, n // per)
                filled = [(first, full, per)] * (full > 0)
                if full < many and (rest := n - full * per):
                    filled.append((first + full, 1, rest))
                    full += 1
                if full < many:
                    filled.append((first + full, many - full, 0))
                for sequence, k, per in filled:
                    if per:
                        self.put(s, k * per, sequence, per, self.capacity - room)
                    over = room - per * s
                    if over:
                        if over not in rooms:
                            rooms[over] = []
                            known.insert(bisect_left(known, over), over)
                        rooms[over].append((sequence, k))


def plan(count: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of count[s] pieces of each length s, of capacity at most."""
    out = Plan(count, capacity)
    out.reduce()
    out.best_fit()
    return out


def lower_bound(count: dict[int, int], capacity: int = CAPACITY) -> int:
    """Martello and Toth's bound L2: no packing has fewer sequences."""
    sizes = np.array(sorted(s for s, n in count.items() if n), np.int64)
    n = np.array([count[s] for s in sizes.tolist()], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for a in [0, *sizes[sizes <= capacity // 2].tolist()]:
        large, middle, small = sizes > capacity - a, (sizes <= capacity - a) & (2 * sizes > capacity), (2 * sizes <= capacity) & (sizes >= a)
        free = int(n[middle].sum()) * capacity - int((sizes * n)[middle].sum())
        best = max(best, int(n[large | middle].sum()) + max(0, -(-(int((sizes * n)[small].sum()) - free) // capacity)))
    return best


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32[, ids], sequence_id, offset): all pieces of docs (see pieces) in as few sequences of capacity tokens as the plan can.

    The pieces of a sequence follow each other from offset 0 without gaps, and sequences are numbered from 0. Null and repeated keys and texts are pieces
    like any others; an empty table gives no rows. Other columns of docs are ignored. Pieces are written once; the driver sees how many have each length.
    """
    spark = docs.sparkSession
    cut, written = materialize(pieces(docs, tokenizer, capacity, end, key, text, keep_ids).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    count = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    made = plan(count, capacity)
    order = sorted(count)
    base = dict(zip(order, np.concatenate([[0], np.cumsum([count[s] for s in order])]).tolist()))
    rules = np.array(sorted((base[s] + a, s, q, per, offset) for s, a, _, q, per, offset in made.rows), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(rules)
    numbered = row_numbers(cut, ["length", "__row"], "__number")  # like pieces may go to any range

    def place(batches):
        first, length, sequence, per, offset = sent.value.T
        for b in batches:
            at = b.column("__number").to_numpy()
            rule = np.searchsorted(first, at, "right") - 1
            k = at - first[rule]
            where = [pa.array(sequence[rule] + k // per[rule]), pa.array(offset[rule] + k % per[rule] * length[rule])]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + where, [*names, "sequence_id", "offset"])

    names = [c for c in cut.columns if c != "__row"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    out, _ = materialize(numbered.select(*names, "__number").mapInArrow(place, f"{fields}, sequence_id long, offset long"), "packed")
    discard(spark, written)
    return out.withColumnRenamed("key", key)
