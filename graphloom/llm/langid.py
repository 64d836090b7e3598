"""Language identification by rank-order profiles.

The most frequent letter 1- to 3-grams of each language, in order, form its profile. A
document's own ranking is compared with each profile by out-of-place distance: the sum of
rank differences, with the profile's length for an n-gram that it lacks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, kept

UNKNOWN = "und"
PROFILE = 300
_CHARS, _ROWS = 400_000, 512
_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _ALPHA


def gram_counts(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, n-gram and count, ordered by owner and n-gram.

    ``owner[i]`` (ascending or not) is the group that text i counts for. Texts are lower-cased;
    all but letters are word borders, which n-grams may hold at their ends only. An n-gram
    is three code points of 21 bits (0: none).
    """
    lowered = [t.lower() for t in texts]
    joined = " " + "  ".join(lowered) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_alpha()[code], code, 32)
    group = np.repeat(owner.astype(np.int64), [len(t) + 2 for t in lowered])
    used = np.flatnonzero(np.bincount(code, minlength=33))  # the space is the smallest
    dense = np.zeros(int(used[-1]) + 1, np.int64)
    dense[used] = np.arange(1, len(used) + 1)
    c = dense[code]
    border = int(dense[32])
    bits = int(len(used)).bit_length()
    letter = c != border
    group <<= 3 * bits
    one = (group | (c << 2 * bits))[letter]
    pair = letter[1:] | letter[:-1]
    two = (group[1:] | (c[:-1] << 2 * bits) | (c[1:] << bits))[pair]
    three = (group[1:-1] | (c[:-2] << 2 * bits) | (c[1:-1] << bits) | c[2:])[letter[1:-1]]
    keys = np.concatenate([one, two, three])
    keys.sort()
    if not len(keys):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(start, len(keys)))
    keys = keys[start]
    back = np.concatenate([[0], used]).astype(np.int64)
    mask = (1 << bits) - 1
    gram = (back[(keys >> 2 * bits) & mask] << 42) | (back[(keys >> bits) & mask] << 21) | back[keys & mask]
    return keys >> 3 * bits, gram, count


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def _count_part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept("language")
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for frame in blocks(frames, "text", _CHARS, _ROWS):
        owner, langs = pd.factorize(frame["lang"])
        group, gram, count = gram_counts(list(frame["text"]), owner)
        for k, lang in enumerate(langs):
            own = slice(*np.searchsorted(group, [k, k + 1]))
            parts = held.setdefault(lang, [])
            parts.append((gram[own], count[own]))
            if len(parts) > 32:
                held[lang] = [_summed(parts)]
    for lang, parts in held.items():
        gram, count = _summed(parts)
        yield pd.DataFrame({"lang": lang, "gram": gram, "n": count})


def language_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """The profiles learned from all rows: (lang, gram, n, rank), rank 0 the most frequent.

    Rows with a null text or language teach nothing. Equal counts rank by n-gram. An n-gram is
    a long of three 21-bit code points. Counts are combined in each task and again before the shuffle.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInPandas(_count_part, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)


def _scorer(langs: list[str], grams: np.ndarray, ranks: np.ndarray, size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("language")
        for frame in blocks(frames, "_read", _CHARS, _ROWS):
            n = len(frame)
            group, gram, count = gram_counts(list(frame["_read"]), np.arange(n))
            order = np.lexsort((gram, -count, group))
            group, gram = group[order], gram[order]
            first = np.searchsorted(group, np.arange(n))
            rank = np.arange(len(group)) - first[group]
            top = rank < size
            group, gram, rank = group[top], gram[top], rank[top]
            found = np.bincount(group, minlength=n)
            distance = np.full((len(langs), n), 1.0)
            if len(grams):
                place = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                known = grams[place] == gram
                for k in range(len(langs)):
                    theirs = ranks[k, place]
                    away = np.where(known & (theirs >= 0), np.abs(theirs - rank), size)
                    distance[k] = np.bincount(group, away, minlength=n) / np.maximum(1, found * size)
            lettered = (found > 0) & bool(langs)
            best = distance.argmin(axis=0) if langs else np.zeros(n, int)
            frame = frame.drop(columns=["_read"])
            frame["lang_pred"] = np.where(lettered, np.array([*langs, UNKNOWN], dtype=object)[best], UNKNOWN)
            frame["score"] = np.where(lettered, 1 - distance[best, np.arange(n)] if langs else 0.0, 0.0)
            yield frame

    return score


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """Each row's ``keep`` columns with lang_pred and score (1 less the distance in parts of the largest possible).

    One output row per input row, repeated rows and null ids included; a null text, a text
    without letters, and any text when no profile was learned give ``und`` with score 0.
    Equal distances go to the alphabetically first language. Columns of docs other than
    ``text`` and ``keep`` take no part. The profiles, at most ``size`` rows for
    each learned language, are collected and sent with the tasks.
    """
    held = profiles.select("lang", "gram", "rank").toPandas()
    langs = sorted(held["lang"].unique())
    grams = np.unique(held["gram"].to_numpy(np.int64))
    ranks = np.full((len(langs), len(grams)), -1, np.int64)
    ranks[[langs.index(x) for x in held["lang"]], np.searchsorted(grams, held["gram"].to_numpy(np.int64))] = held["rank"]
    rows = docs.select(*keep, F.col(text).alias("_read"))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInPandas(_scorer(langs, grams, ranks, size), schema)
