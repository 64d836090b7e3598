"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size. Those of up to 16 shingles are looked up exactly: a document that
holds enough of an item's n shingles has one of any n - needed + 1 of them, and the rarest are taken.
For each larger size class documents are cut into overlapping windows three times as long as the class's longest item, so that an item that a document holds is a
large part of some window, however long the document is. Items and windows have MinHash
signatures of 64 independent minima; one common minimum makes a candidate. Candidates
are verified by exact containment: the share of the item's distinct shingles that the whole document has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, free_name, kept, mix, rolling, shingles, word_hashes, written

WIDTH = 5
HASHES = 64
BASE = 16
#: Characters of benchmark text that one pass over the documents looks for (some tens of MB with its tables).
PASS_CHARS = 8_000_000
_NONE = np.uint32(0xFFFFFFFF)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seed[:n] | np.uint64(1)), seed[n:]


def _permuted(values: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """One of the random orders of all shingles: the upper half of a * x + b."""
    return ((values * a + b) >> np.uint64(32)).astype(np.uint32)


class ItemIndex:
    """The items of a block: their distinct shingles, those that short items are looked up by, and for each size class and hash the sorted minima."""

    def __init__(self, texts: list[str], threshold: float = 0.8, hashes: int = HASHES):
        self.hashes = hashes
        words = [word_hashes(t) for t in texts]
        self.sets = [np.unique(shingles(w, WIDTH)) for w in words]
        a, b = _seeds(hashes)
        self.a, self.b = a, b
        self.short: dict[int, dict[int, list[int]]] = {}
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if 0 < len(w) < WIDTH:
                self.short.setdefault(len(w), {}).setdefault(int(self.sets[k][0]), []).append(k)
            elif len(w):
                level = max(0, int(np.ceil(np.log2((len(w) - WIDTH + 1) / BASE))))
                classes.setdefault(level, []).append(k)
        self.rare = self._rarest(classes.pop(0, []), threshold)
        self.classes = {}
        for level, own in classes.items():
            minima = np.stack([[_permuted(self.sets[k], a[h], b[h]).min() for h in range(hashes)] for k in own])
            size = 1 << min(24, max(16, int(minima.size - 1).bit_length() + 6))
            seen = np.zeros(size, bool)
            seen[minima.ravel() & np.uint32(size - 1)] = True
            order = np.argsort(minima, axis=0, kind="stable")
            self.classes[level] = (seen, np.take_along_axis(minima, order, 0), np.array(own)[order])

    def _rarest(self, own: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray, list[list[int]]] | None:
        """A bit table and the sorted shingles of which a document has one at least if it holds one of the items, and each shingle's items."""
        if not own:
            return None
        values, counts = np.unique(np.concatenate([self.sets[k] for k in own]), return_counts=True)
        lists: dict[int, list[int]] = {}
        for k in own:
            shingle = self.sets[k]
            needed = int(np.ceil(threshold * len(shingle) - 1e-9))
            order = np.argsort(counts[np.searchsorted(values, shingle)], kind="stable")
            for value in shingle[order[: len(shingle) - needed + 1]].tolist():
                lists.setdefault(value, []).append(k)
        keys = np.array(sorted(lists), np.uint64)
        seen = np.zeros(1 << min(24, max(16, len(keys).bit_length() + 6)), bool)
        seen[keys & np.uint64(len(seen) - 1)] = True
        return seen, keys, [lists[v] for v in keys.tolist()]

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(document, item) pairs with a common rare shingle or minimum; ``docs``: the shingle hashes of each, in order."""
        found: set[tuple[int, int]] = set()
        if not docs:
            return found
        n = np.array([len(d) for d in docs])
        if self.rare:
            seen, keys, lists = self.rare
            values = np.concatenate(docs)
            hit = np.flatnonzero(seen[values & np.uint64(len(seen) - 1)])
            at = np.minimum(np.searchsorted(keys, values[hit]), len(keys) - 1)
            same = keys[at] == values[hit]
            doc = np.searchsorted(np.cumsum(n), hit[same], side="right")
            for d, k in set(zip(doc.tolist(), at[same].tolist(), strict=True)):
                found.update((d, i) for i in lists[k])
        if not self.classes:
            return found
        cells = -(-n // BASE)
        first = np.concatenate([[0], np.cumsum(cells)])
        values = np.concatenate(docs)
        owner = np.repeat(np.arange(len(docs)), n)
        place = np.arange(len(values)) + (first[:-1] * BASE - np.concatenate([[0], np.cumsum(n)[:-1]]))[owner]
        layout = {}
        for level in self.classes:
            step = 1 << level
            count = -(-cells // step)
            at = np.concatenate([[0], np.cumsum(count)])
            doc = np.repeat(np.arange(len(docs)), count)
            start = first[doc] + (np.arange(at[-1]) - at[doc]) * step
            left = at[doc + 1] - np.arange(at[-1])  # windows of the document from this one on
            layout[level] = (doc, start, left)
        padded = np.empty(int(first[-1]) * BASE, np.uint32)
        for h in range(self.hashes):
            padded.fill(_NONE)
            padded[place] = _permuted(values, self.a[h], self.b[h])
            least = padded
            for _ in range(BASE.bit_length() - 1):
                least = np.minimum(least[0::2], least[1::2])
            for level, (doc, start, left) in layout.items():
                cell = np.minimum.reduceat(least, start) if level else least
                window = cell.copy()
                for k in (1, 2):
                    more = left[:-k] > k if len(left) > k else np.empty(0, bool)
                    window[:-k][more] = np.minimum(window[:-k][more], cell[k:][more])
                seen, minima, items = self.classes[level]
                hit = np.flatnonzero(seen[window & np.uint32(len(seen) - 1)])
                lo = np.searchsorted(minima[:, h], window[hit], "left")
                hi = np.searchsorted(minima[:, h], window[hit], "right")
                for w in np.flatnonzero(hi > lo):
                    d = int(doc[hit[w]])
                    found.update((d, int(i)) for i in items[lo[w] : hi[w], h])
        return found


def _finder(items: list[tuple[object, str]], threshold: float, keep: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("decontamination")
        index = ItemIndex([t for _, t in items], threshold)
        for frame in blocks(frames, "_text", 1_000_000):
            words = [word_hashes(t) for t in frame["_text"]]
            docs = [rolling(w, WIDTH) for w in words]
            rows: dict[tuple[int, int], tuple[int, int]] = {}
            held: dict[int, np.ndarray] = {}
            for d, i in index.candidates(docs):
                if d not in held:
                    held[d] = np.unique(docs[d])
                own = index.sets[i]
                place = np.minimum(np.searchsorted(held[d], own), len(held[d]) - 1)
                rows[d, i] = (int((held[d][place] == own).sum()), len(own))
            for width, wanted in index.short.items():
                for d, w in enumerate(words):
                    for value in np.intersect1d(rolling(w, width), np.fromiter(wanted, np.uint64, len(wanted))):
                        rows.update({(d, i): (1, 1) for i in wanted[int(value)]})
            good = sorted((d, i, s, n) for (d, i), (s, n) in rows.items() if s >= threshold * n - 1e-9)
            out = frame[keep].iloc[[g[0] for g in good]].reset_index(drop=True)
            out["item_id"] = pd.array([items[g[1]][0] for g in good], dtype="Int64")
            out["n_shared"] = [g[2] for g in good]
            out["n_shingles"] = [g[3] for g in good]
            out["containment"] = [g[2] / g[3] for g in good]
            yield out

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Pairs of documents and the items they hold: the ``keep`` columns, item_id, n_shared, n_shingles, containment.

    Whole texts are cut into lower-cased words; shingles are five words, and an item with fewer words is one
    shingle of all its words, sought among the documents' runs of as many. Items and documents
    that are null or without words take no part; repeated rows of either give repeated pairs, and null ids
    are kept. Other columns take no part. An item of up to 20 words that a document contains to ``threshold`` or
    more is always found, a longer one missed with a chance below one in a thousand (whole copies: below one in ten million).

    The items are sent with the tasks in blocks of about PASS_CHARS characters, each block one pass
    over the documents, of which the driver holds one at a time; documents are never shuffled.
    """
    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    passes = max(1, -(-chars // PASS_CHARS))
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep).schema
    for name, kind in (("item_id", "long"), ("n_shared", "long"), ("n_shingles", "long"), ("containment", "double")):
        schema = schema.add(name, kind)
    found = []
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).orderBy("i", "t").collect()
        pairs = rows.mapInPandas(_finder([(r["i"], r["t"]) for r in own], threshold, list(keep)), schema)
        found.append(pairs if passes == 1 else written(pairs, "contaminated"))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose text holds no benchmark item; rows are judged by their own text, whatever their id.

    Found pairs carry the text's digest; the removal joins on it, by broadcast while there are few
    contaminated texts and by shuffle otherwise.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    own = free_name("_digest", *docs.columns)
    bad = contaminated(docs.select(text, digest.alias(own)), benchmark, text, (own,), threshold=threshold).select(own).distinct()
    bad = written(bad, "digests")
    if bad.count() <= 200_000:  # 100 bytes each
        bad = F.broadcast(bad)
    return docs.withColumn(own, digest).join(bad, own, "left_anti").select(*docs.columns)
