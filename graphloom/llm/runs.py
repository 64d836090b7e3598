"""Periodic runs of words: stretches in which the same words come again at a fixed distance.

A run of period q is a diagonal: word i equals word i - q for many i in a row. The search is an online
dynamic program over sparse diagonals: at each word, the lags to its earlier occurrences go one match further or begin,
all other lags end, and a lag that ends after enough matches is a run, which is emitted there and then.

All earlier occurrences of a frequent word are too many, and nearly all are of no use. A run of period q has at least 2q
matches. So with g, the power of two from q on (g / 2 < q <= g), the g words up to word i come again q words earlier wherever the
run's diagonal is g matches long; and in a run whose smallest period is q they come again at no smaller distance, as
no primitive word is a proper rotation of itself. The one earlier occurrence that can matter for lags in (g / 2, g] is therefore
the last one of the g words up to i, if it is in that range. Windows of g words that come again are found for
g = 1, 2, 4, ... by the names of their halves, as long as any come again; prose has few beyond g = 8. No occurrence
that could lie on a run is left out, and a text of n words has at most n occurrences to follow for each g.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from graphloom.llm.common import free_name, text_batches, with_columns

MIN_WORDS = 24
MIN_REPEATS = 3
#: Bytes of text whose windows are named together.
BLOCK_BYTES = 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def occurrences(words: np.ndarray, doc: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, g) of the earlier occurrences that can lie on a run, by place; lags up to ``longest``, within one document.

    words, doc: the number of each word and of its document; a document's words are together.
    """
    n, g = len(words), 1
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    starts = np.arange(n)
    found = []
    name = np.zeros(n, np.int64)
    while len(starts) and g // 2 < longest:
        order = np.argsort(key, kind="stable")
        sorted_key, at = key[order], starts[order]
        same = sorted_key[1:] == sorted_key[:-1]
        lag = at[1:] - at[:-1]
        near = same & (lag <= min(g, longest)) & (lag > g // 2)
        if near.any():
            found.append((at[1:][near] + g - 1, lag[near], np.full(int(near.sum()), g)))
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        name[:] = 0
        name[at[again]] = (np.cumsum(np.concatenate([[True], ~same])))[again]
        # Twice as long windows come again only where both halves do.
        starts = np.flatnonzero(name[: max(0, n - g)])
        starts = starts[name[starts + g] > 0]
        key = name[starts] * (n + 1) + name[starts + g]
        g *= 2
    if not found:
        return (np.empty(0, np.int64),) * 3
    place, lag, g = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((lag, place))
    return place[order], lag[order], g[order]


def find_runs(words: np.ndarray, doc: np.ndarray, longest: int, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with at least ``min_words`` words and ``min_repeats`` (3 or more) periods, by start, then period."""
    runs = []

    def end(matches: dict[int, int], stop: int) -> None:
        for lag, m in matches.items():
            length = m + lag
            if length >= min_words and length >= min_repeats * lag:
                runs.append((stop - length, length, lag))

    before: dict[int, int] = {}
    now: dict[int, int] = {}
    at = -2
    for place, lag, g in zip(*(x.tolist() for x in occurrences(words, doc, longest))):
        if place != at:
            end(before, at)
            before = now
            if place != at + 1:
                end(before, at + 1)
                before = {}
            now, at = {}, place
        now[lag] = before.pop(lag, g - 1) + 1
    end(before, at)
    end(now, at + 1)
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """The periodic runs of every whole text, and the text without their repetitions.

    Words are separated by ASCII white space and numbered from 0. A run is a stretch whose words equal those ``period`` words
    earlier, for its smallest period, that is at least ``min_words`` words and ``min_repeats`` (3 or more) periods long and
    that a neighbouring word can't extend. Output: the ``keep`` columns (one named like an output gives way), n_words (bigint), runs
    (array of start, length, period, by start and then period) and collapsed (the words joined by a space, without those in any run
    after that run's first period).

    A null or empty text has no words, no runs and an empty collapsed text. Repeated rows and null ids are rows like others, an empty
    table gives no rows. A text is one row: its words are in one task's memory, some 150 bytes for each.
    """
    if min_repeats < 3:
        raise ValueError("a run has at least three periods")
    keep = tuple(k for k in keep if k.lower() not in ("n_words", "runs", "collapsed"))
    own = free_name("_text", *keep)
    rows = docs.select(*keep, F.col(text).cast("string").alias(own))
    schema = rows.select(*keep).schema.add("n_words", "long").add("runs", ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, own, BLOCK_BYTES):
            split = [t.split() for t in texts]
            sizes = np.array([len(s) for s in split], np.int64)
            stops = np.cumsum(sizes)
            flat = [w for s in split for w in s]
            words = pd.factorize(np.array(flat, object))[0] if flat else np.empty(0, np.int64)
            doc = np.repeat(np.arange(len(split)), sizes)
            of: list[list[dict[str, int]]] = [[] for _ in split]
            dropped = np.zeros(len(flat) + 1, np.int64)
            for start, length, period in find_runs(words, doc, int(sizes.max(initial=0)) // min_repeats, min_words, min_repeats):
                of[doc[start]].append({"start": start - int(stops[doc[start]] - sizes[doc[start]]), "length": length, "period": period})
                dropped[start + period] += 1
                dropped[start + length] -= 1
            kept = np.cumsum(dropped)[:-1] == 0
            collapsed = [b" ".join(compress(s, kept[e - len(s) : e].tolist()) if r else s) for s, e, r in zip(split, stops.tolist(), of)]
            yield with_columns(batch, n_words=pa.array(sizes), runs=pa.array(of, RUNS), collapsed=pa.array(collapsed, pa.binary()).cast(pa.string()))

    return rows.mapInArrow(run, schema)
