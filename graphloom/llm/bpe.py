"""Byte-level BPE by sentencepiece: the vocabulary's ranks become a sentencepiece model, without any training.

A sentencepiece BPE model joins, again and again, the two neighbours whose joint piece has the highest score. With each
token's bytes written as letters and its negative rank as its score, it joins the pair of least rank, the first of them where
several tie, which is byte-level BPE. The model is serialised here, field by field.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from graphloom.llm.common import free_name, kept, text_batches, with_columns

#: Pre-tokens whose ids a worker remembers from one slice to the next.
REMEMBERED = 200_000
BLOCK_BYTES = 1 << 20
#: Characters of a text that are cut into pre-tokens at a time.
SLICE = 1 << 18


def byte_letters() -> list[str]:
    """A letter for each byte: itself if it is printable and no blank in Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


LETTERS = byte_letters()
_AS_LETTERS = dict(enumerate(LETTERS))
_AS_BYTES = {ord(letter): b for b, letter in _AS_LETTERS.items()}


def to_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_AS_LETTERS)


def to_bytes(letters: str) -> bytes:
    return letters.translate(_AS_BYTES).encode("latin-1")


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: a varint, a 32-bit float, or bytes with their length."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes], ranks: list[int]) -> bytes:
    """A sentencepiece model: piece k is token k in letters, its score minus its rank; one unknown piece follows them."""
    # Field numbers and enumeration values of the model format.
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, to_letters(t).encode()) + _field(2, float(-r)) + _field(3, normal)) for t, r in zip(tokens, ranks, strict=True)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


@dataclass
class Codec:
    """Encodes texts and decodes ids by a rank file's vocabulary; ids are its ranks."""

    path: str
    pattern: str

    def __post_init__(self) -> None:
        self.ranks = read_ranks(self.path)
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        own = [self.ranks[t] for t in tokens]
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(tokens, own))
        self.rank_of = np.array(own, "<i4")
        self.bytes_of = {rank: to_bytes(self.model.IdToPiece(k)) for k, rank in enumerate(own)}
        # The same by position, empty where there is no such id, for whole columns of ids.
        self.table = pa.array([self.bytes_of.get(rank, b"") for rank in range(max(own, default=-1) + 1)], pa.large_binary())
        self.known = np.zeros(len(self.table), bool)
        self.known[own] = True
        self.cut = regex.compile(self.pattern)
        self.recent: dict[str, bytes] = {}

    def learn(self, pre_tokens: set[str]) -> dict[str, bytes]:
        """The ids of pre-tokens, as 32-bit little-endian bytes. A pre-token that is a token is that token, whatever joins lead to it."""
        data = {p: p.encode("utf-8", "surrogatepass") for p in pre_tokens}
        made = {p: struct.pack("<i", self.ranks[d]) for p, d in data.items() if d in self.ranks}
        rest = [p for p in data if p not in made]
        encoded = self.model.Encode([to_letters(data[p]) for p in rest], num_threads=1)
        flat = self.rank_of[[k for ids in encoded for k in ids]].tobytes()
        at = 0
        for p, ids in zip(rest, encoded, strict=True):
            made[p] = flat[at : at + 4 * len(ids)]
            at += 4 * len(ids)
        return made

    def slices(self, text: str) -> Iterator[str]:
        """Parts of a text between which pre-tokens end: no pre-token goes on from another character into white space."""
        at = 0
        while len(text) - at > SLICE:
            stop = text.find(" ", at + SLICE)
            while stop > 0 and text[stop - 1].isspace():
                stop = text.find(" ", stop + 1)
            if stop < 0:
                break
            yield text[at:stop]
            at = stop
        yield text[at:]

    def encode(self, text: str) -> bytes:
        """All ids of a text, as 32-bit little-endian bytes."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Pre-tokens that are not remembered go to the model together, for all texts of a slice's length at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for part in self.slices(text):
                group.append((k, self.cut.findall(part)))
                size += len(part)
                if size >= SLICE:
                    self._look_up(group, out)
                    group, size = [], 0
        self._look_up(group, out)
        return [b"".join(parts) for parts in out]

    def _look_up(self, group: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.recent) > REMEMBERED:
            self.recent.clear()
        new = {p for _, found in group for p in found if p not in self.recent}
        if new:
            self.recent |= self.learn(new)
        for k, found in group:
            out[k] += map(self.recent.__getitem__, found)

    def decode(self, ids: Iterable[int]) -> bytes | None:
        """The bytes of all ids; None if there is an id that the vocabulary lacks."""
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            return None


    def decode_column(self, ids: pa.ListArray) -> pa.Array:
        """``decode`` of each row; null for null rows and for those with a null."""
        flat = ids.flatten()
        numbers = flat.to_numpy(zero_copy_only=False) if not flat.null_count else None
        if ids.null_count or numbers is None or len(numbers) and (numbers.min() < 0 or numbers.max() >= len(self.known) or not self.known[numbers].all()):
            return pa.array([None if x is None else self.decode(x) for x in ids.to_pylist()], pa.binary())
        if not len(flat):
            return pa.array([b""] * len(ids), pa.binary())
        pieces = self.table.take(flat)
        # The pieces' bytes lie one after the other: rows are cut out of them.
        ends = np.frombuffer(pieces.buffers()[1], "<i8", len(pieces) + 1, pieces.offset * 8)
        starts = ids.offsets.to_numpy()
        stops = ends[starts - starts[0]].astype("<i4")
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(stops.tobytes()), pieces.buffers()[2]])


def codec(path: str, pattern: str) -> Codec:
    """The codec of this Python worker, made once."""
    own = kept("bpe")
    if (path, pattern) not in own:
        own[path, pattern] = Codec(path, pattern)
    return own[path, pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ids of every whole text by a rank file's vocabulary, each match of ``pattern`` by itself, without special tokens.

    Output: the ``keep`` columns (one named ids gives way) and ids (array of int). A null text counts as an empty one, which has no
    ids. Repeated rows and null ids of documents are rows like others; an empty table gives no rows. Long texts are cut into
    pre-tokens part by part.
    """
    keep = tuple(k for k in keep if k.lower() != "ids")
    own = free_name("_text", *keep)
    rows = docs.select(*keep, F.col(text).cast("string").alias(own))
    schema = rows.select(*keep).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(vocabulary, pattern)
        for batch, texts in text_batches(batches, own, BLOCK_BYTES):
            data = made.encode_all([t.decode() for t in texts])
            stops = np.cumsum([0, *(len(d) // 4 for d in data)])
            ids = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4")))
            yield with_columns(batch, ids=ids)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bytes that every row's ids stand for: the ``keep`` columns (one named decoded gives way) and decoded (binary).

    Null for null ids and for ids with a null or one that the vocabulary lacks; no ids are no bytes. ``pattern`` as in ``encode``: a worker
    has one model for both.
    """
    keep = tuple(k for k in keep if k.lower() != "decoded")
    own = free_name("_ids", *keep)
    rows = encoded.select(*keep, F.col(ids).alias(own))
    schema = rows.select(*keep).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(vocabulary, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):  # few rows at a time, as the bytes of all are in one piece
                part = batch.slice(first, 64)
                yield with_columns(part.drop_columns([own]), decoded=made.decode_column(part.column(own)))

    return rows.mapInArrow(run, schema)
