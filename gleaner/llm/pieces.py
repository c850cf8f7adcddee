"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed here, and its normaliser, space marker, scores and byte fallback are rebuilt as a
tokenizers pipeline: a unigram model keeps its scores; a BPE model, whose scores are ranks, becomes the list of
merges in score order.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import textkit as tk

#: A public vocabulary file; only the driver reads it.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts whose results a worker remembers, some 250 bytes each.
SEEN = 100_000


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at : at + size])[0]
            at += size
        else:
            raise ValueError("not a model file")


def parse(data: bytes) -> Model:
    """The model in the bytes of a .model file."""
    pieces, found = [], {}
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            pieces.append((p.get(1, b"").decode(), float(p.get(2, 0.0)), int(p.get(3, NORMAL))))
        elif number == 2:
            t = dict(_fields(value))
            unk = t.get(40, 0)
            found |= {"kind": t.get(3, UNIGRAM), "unk_id": unk, "byte_fallback": bool(t.get(35, 0))}
            if t.get(24, 0):
                raise ValueError("models that mark spaces behind words are not supported")
        elif number == 3:
            n = dict(_fields(value))
            found |= {"charsmap": n.get(2, b""), "dummy_prefix": bool(n.get(3, 1)), "squeeze": bool(n.get(4, 1)), "escape": bool(n.get(5, 1))}
    if not pieces:
        raise ValueError("the model has no pieces")
    if any(kind == USER_DEFINED for _, _, kind in pieces):
        raise ValueError("models with pieces of the user's own, which are matched before segmentation, are not supported")
    return Model(tuple(pieces), **found)


def build(model: Model):
    """A tokenizers.Tokenizer that encodes as the model does; decoding is by piece_bytes."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    names = [p for p, _, _ in model.pieces]
    if model.kind == UNIGRAM:
        # control and unused pieces keep their ids under names that no text has, as a text may spell them out
        hidden = [f"\x00{i}\x00" if kind in (CONTROL, UNUSED, UNKNOWN) else p for i, (p, _, kind) in enumerate(model.pieces)]
        core = models.Unigram([(p, s) for p, (_, s, _) in zip(hidden, model.pieces)], model.unk_id, model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, p in enumerate(names)}
        usable = {p for p, _, kind in model.pieces if kind == NORMAL}
        merges = []
        for piece, score, kind in model.pieces:
            if kind == NORMAL and len(piece) > 1:
                for cut in range(1, len(piece)):
                    if piece[:cut] in usable and piece[cut:] in usable:
                        merges.append((-score, vocab[piece], vocab[piece[:cut]], (piece[:cut], piece[cut:])))
        merges.sort()
        core = models.BPE(vocab, [m[-1] for m in merges], unk_token=names[model.unk_id], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models")
    out = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    return out


def piece_bytes(model: Model) -> list[bytes]:
    """What each id decodes to."""
    out = []
    for piece, _, kind in model.pieces:
        if kind == BYTE:
            out.append(bytes([int(piece[3:5], 16)]))
        elif kind in (CONTROL, UNKNOWN):
            out.append(b"" if kind == CONTROL else " ⁇ ".encode())
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out


class Codec:
    """Encodes and decodes batches; one lives in each Python worker."""

    def __init__(self, data: bytes, built: str | None = None):
        from tokenizers import Tokenizer, normalizers

        self.data, self.model = data, parse(data)
        self.tokenizer = Tokenizer.from_str(built) if built else build(self.model)
        self.surface = piece_bytes(self.model)
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        self._own = None
        #: What came out for texts that this worker has seen, by a 128-bit hash of the text.
        self.seen: dict[bytes, tuple] = {}
        #: Without a charsmap the normaliser only marks spaces, which Python's str.replace does faster.
        self.plain = None
        if not self.model.charsmap and not self.model.squeeze and self.model.escape:
            self.plain = Tokenizer.from_str(self.tokenizer.to_str())
            self.plain.normalizer = normalizers.Sequence([])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if self.plain:
            first = MARK if self.model.dummy_prefix else ""
            texts = [first + t.replace(" ", MARK) if t else "" for t in texts]
        tokenizer = self.plain or self.tokenizer
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if self.model.dummy_prefix and out.startswith(" ") else out

    def reference_ids(self, text: str) -> list[int]:
        """What the sentencepiece library itself makes of the text."""
        if self._own is None:
            import sentencepiece

            self._own = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._own.encode(text)


_codecs: dict[int, Codec] = {}


def _codec(key: int, data: bytes, built: str) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, built)
    return _codecs[key]


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, text: str = "text", key: str = "doc_id", parity_every: int = 1, keep_ids: bool = True) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, n_byte_tokens, ids_sha256, round_trip, parity[, ids]), one for each row of docs.

    ids are the token ids of the whole text; ids_sha256 is the hash of them as little-endian 32-bit numbers.
    round_trip: decoding gives the text again (U+2581 counts as a space, as in the model itself). parity: whether the
    sentencepiece library gives the same ids, for rows whose crc32(key as text) is a multiple of parity_every (all by default); else null.
    A null or empty text has no tokens. Repeated rows and null keys stay; other columns of docs are ignored. The text is
    read in one pass without a shuffle; a worker holds one slice of about 1 MB, or one text. model_path: a unigram or BPE model; the driver reads it.
    """
    spark: SparkSession = docs.sparkSession
    with open(model_path, "rb") as f:
        data = f.read()
    built = build(parse(data)).to_str()
    sent = spark.sparkContext.broadcast((zlib.crc32(data), data, built))
    names = ["key", "n_bytes", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip", "parity"] + ["ids"] * keep_ids

    def measured(codec: Codec, texts: list[str], wanted: list[bool]) -> tuple[list[tuple], list[np.ndarray]]:
        """For each text (n_tokens, n_byte_tokens, ids_sha256, round_trip, parity), and its ids."""
        found = codec.encode(texts)
        rows = [
            (len(i), int(codec.is_byte[i].sum()), hashlib.sha256(i.astype("<i4").tobytes()).hexdigest(), codec.decode(i) == t.replace(MARK, " "), codec.reference_ids(t) == i.tolist() if w else None)
            for i, t, w in zip(found, texts, wanted)
        ]
        return rows, found

    def run(batches):
        codec = _codec(*sent.value)
        for part in tk.slices(batches):
            texts = [x or "" for x in part.column("text").to_pylist()]
            if keep_ids or parity_every != 1:
                keys = part.column("key").to_pylist()
                wanted = [bool(parity_every) and zlib.crc32(("" if k is None else str(k)).encode()) % parity_every == 0 for k in keys]
                rows, found = measured(codec, texts, wanted)
            else:  # a text that this worker has seen needs no second look
                marks = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
                new = {m: t for m, t in zip(marks, texts) if m not in codec.seen}
                known = {m: codec.seen[m] for m in marks if m in codec.seen}
                known.update(zip(new, measured(codec, list(new.values()), [True] * len(new))[0]))
                rows = [known[m] for m in marks]
                if len(codec.seen) > SEEN:
                    codec.seen.clear()
                codec.seen.update((m, known[m]) for m in new)
            n_tokens, n_bytes, shas, same, checked = zip(*rows)
            cols = [part.column("key"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_bytes, pa.int64())]
            cols += [pa.array(shas, pa.string()), pa.array(same, pa.bool_()), pa.array(checked, pa.bool_())]
            if keep_ids:
                cut = np.concatenate([[0], np.cumsum([len(i) for i in found])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean, parity boolean" + ", ids array<int>" * keep_ids
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(tk.lean(run), schema).withColumnRenamed("key", key)


def decode(rows: DataFrame, model_path: str = DEFAULT_MODEL, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Rows (key, text): the text of each row's ids. Null ids give a null text, no ids an empty one."""
    with open(model_path, "rb") as f:
        data = f.read()
    sent = rows.sparkSession.sparkContext.broadcast((zlib.crc32(data), data, build(parse(data)).to_str()))

    def run(batches):
        codec = _codec(*sent.value)
        for part in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(rows[key].alias("key"), rows[ids].alias("ids")).mapInArrow(tk.lean(run), f"key {kind}, text string").withColumnRenamed("key", key)

