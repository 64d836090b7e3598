"""Packing of tokenised documents into fixed windows by dynamic programming.

Documents keep their order. A window may end at a document's end, at a sentence's end for a
small price, and inside a sentence, at every 16th token, for a higher one. The cheapest
sequence of cuts is found from left to right: the cost of ending a window at boundary j is

    best[j] = min over i of best[i] + (capacity - (pos[j] - pos[i])) + penalty[j]

over all boundaries i at most ``capacity`` tokens before j. As capacity - pos[j] + penalty[j] is
the same for all i, the minimum of best[i] + pos[i] over a sliding range is wanted, which
a monotone queue yields in constant amortised time.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm.common import Recent, blocks, kept

CAPACITY = 2048
END_ID = 1
SENTENCE_PENALTY = 1.0
INSIDE_PENALTY = 12.0
INSIDE_STEP = 16
#: Tokens that one dynamic program covers at most, unless one document is longer.
SPAN_TOKENS = 1_000_000
#: Words, and as many pieces of words, whose ids a worker remembers, twice as many at most (some 200 bytes each).
REMEMBERED = 250_000
_ENDS = ".!?"
# Fixed value: the pattern by which this vocabulary cuts text into pieces.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> list[str]:
    """For each byte the character that stands for it in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    at = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [at[b] for b in range(256)]


class WordTokens:
    """The ids of each word between white space, as little-endian 32-bit bytes; those of recent words are remembered.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words. Words of printable Latin characters are cut into pieces here by the vocabulary's own
    pattern and go to its model directly; all others, and those that hold an added token (such as
    <|endoftext|>, which has an id of its own even inside a word), go through the whole tokenizer.
    """

    def __init__(self, path: str, bound: int = REMEMBERED):
        self.pieces, self.words = Recent(self._piece, bound), Recent(self._word, bound)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.ends = sorted({i for w in (*_ENDS, "a.", "a!", "a?") for i in self.tokenizer.encode(w, add_special_tokens=False).ids[-1:]})

    def _piece(self, piece: str) -> bytes:
        letters = self.letters
        mapped = "".join([letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word and max(word) < "ɐ" and not any(t in word for t in self.added) and word.isprintable() and unicodedata.is_normalized("NFC", word):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        """The ids of a whole text."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.words.__getitem__, words))


def word_tokens(path: str, remembered: int) -> WordTokens:
    """The worker's tokenizer for a vocabulary file."""
    own = kept("packing")
    if (path, remembered) not in own:
        own[path, remembered] = WordTokens(path, remembered)
    return own[path, remembered]


def best_cuts(pos: np.ndarray, penalty: np.ndarray, capacity: int) -> np.ndarray:
    """Indexes of the chosen boundaries, the last one included.

    ``pos``: ascending boundary positions, from 0; no two neighbours more than ``capacity`` apart.
    """
    places, prices = pos.tolist(), penalty.tolist()
    n = len(places)
    back = [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # best[i] + pos[i], pos[i], i
    for j in range(1, n):
        at = places[j]
        least = at - capacity
        while queue[0][1] < least:
            queue.popleft()
        value, _, i = queue[0]
        back[j] = i
        value += capacity + prices[j]  # best[j] + pos[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, at, j))
    cuts = [n - 1]
    while back[cuts[-1]]:
        cuts.append(back[cuts[-1]])
    return np.array(cuts[::-1])


def _boundaries(ids: np.ndarray, ends: np.ndarray, sentence_ids: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window may end, 0 first, and their penalties. ``ends``: where documents end."""
    lookup = np.zeros(int(max(ids.max(initial=0), max(sentence_ids, default=0))) + 1, bool)
    lookup[sentence_ids] = True
    total = len(ids)
    price = np.full(total + 1, np.inf, np.float32)
    price[:: min(INSIDE_STEP, capacity)] = INSIDE_PENALTY
    price[np.flatnonzero(lookup[ids]) + 1] = SENTENCE_PENALTY
    price[ends] = 0.0
    price[0] = 0.0
    pos = np.flatnonzero(price < np.inf)
    return pos, price[pos]


def pack_tokens(texts: list[bytes], capacity: int, sentence_ids: list[int]) -> pd.DataFrame:
    """Pieces of documents given as 32-bit ids: doc (index), start, length, ids_crc32, doc_tokens, window, offset."""
    data = b"".join(texts)
    ids = np.frombuffer(data, "<u4")
    lengths = np.array([len(t) // 4 for t in texts], np.int64)
    ends = np.cumsum(lengths)
    pos, penalty = _boundaries(ids, np.unique(ends), sentence_ids, capacity)
    cuts = pos[best_cuts(pos, penalty, capacity)]
    # A piece begins wherever a document or a window begins.
    stops = np.union1d(cuts, ends[lengths > 0])
    begins = np.concatenate([[0], stops[:-1]])
    doc = np.searchsorted(ends, begins, side="right")
    window = np.searchsorted(cuts, begins, side="right")
    opened = np.concatenate([[0], cuts])[window]
    view = memoryview(data)
    sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
    return pd.DataFrame({"doc": doc, "start": begins - (ends - lengths)[doc], "length": stops - begins, "ids_crc32": np.array(sums, np.int64), "doc_tokens": lengths[doc], "window": window, "offset": begins - opened})


def pack(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """Packs whole texts into windows of at most ``capacity`` tokens, one output row per piece.

    A document's tokens are its text's ids and then id 1, so a null or empty text is one token.
    Each input partition is packed by itself, in its order and in spans of about one million
    tokens; the last window of a span is as short as what is left. Output: the ``keep`` columns of the piece's
    row (repeated rows and null ids are packed like others) and start, length,
    ids_crc32, doc_tokens, sequence_id, offset, padding. A sequence is padded to ``capacity``, except
    when its length is a power of two; its id holds the partition in the bits from the 33rd.
    Other columns take no part. An empty table gives no rows. ``remembered`` trades a worker's memory for time, never results.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep).schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"):
        schema = schema.add(name, "long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_tokens(vocabulary, remembered)
        end = np.array([END_ID], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 33
        used = 0

        def packed(held: list[pd.DataFrame], tokens: list[bytes]) -> pd.DataFrame:
            nonlocal used
            pieces = pack_tokens(tokens, capacity, words.ends)
            out = pd.concat(held, ignore_index=True).iloc[pieces["doc"].to_numpy()].reset_index(drop=True)
            total = np.bincount(pieces["window"], pieces["length"]).astype(np.int64)
            filled = np.where((total & (total - 1)) == 0, 0, capacity - total)
            for name in ("start", "length", "ids_crc32", "doc_tokens"):
                out[name] = pieces[name].to_numpy()
            out["sequence_id"] = base + used + pieces["window"].to_numpy()
            out["offset"] = pieces["offset"].to_numpy()
            out["padding"] = filled[pieces["window"].to_numpy()]
            used += len(total)
            return out

        held, tokens, size = [], [], 0
        for frame in blocks(frames, "_text", 1_000_000):
            got = [words.text(t) + end for t in frame["_text"]]
            held.append(frame.drop(columns=["_text"]))
            tokens += got
            size += sum(map(len, got)) // 4
            if size >= SPAN_TOKENS:
                yield packed(held, tokens)
                held, tokens, size = [], [], 0
        if tokens:
            yield packed(held, tokens)

    return rows.mapInPandas(run, schema)
