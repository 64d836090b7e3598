"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share.

    It lies in the cluster's ``spark.checkpoint.dir``; only where that is unset (local
    runs and tests) a temporary folder is made and set as the checkpoint folder.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root is None:
        root = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_by_hash(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """``n`` rows chosen by hashes of their columns, in the order of column ``_h``; nearly all others go before anything is sorted.

    Copies of a row stay or go together, so that too few may stay; then all rows are sorted.
    """
    total = max(1, rows.count())
    share = min(1.0, (2 * n + 100) / total)
    hashed = rows.withColumn("_h", F.xxhash64(*columns))
    near = hashed.where(F.pmod(F.hash("_h"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    first = near.orderBy("_h", *columns).limit(n)
    return first if first.count() >= min(n, total) else hashed.orderBy("_h", *columns).limit(n)


def id_hash(column: str = "doc_id") -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def blocks(frames: Iterable[pd.DataFrame], column: str, chars: int, rows: int = 1 << 30) -> Iterator[pd.DataFrame]:
    """Slices of the frames with at most ``chars`` characters and ``rows`` rows each.

    A longer text forms a slice by itself; null texts become empty.
    """
    for frame in frames:
        if not len(frame):
            continue
        frame = frame.reset_index(drop=True)
        frame[column] = [t if isinstance(t, str) else "" for t in frame[column]]
        total, first = 0, 0
        for i, n in enumerate(map(len, frame[column])):
            if i > first and (total + n > chars or i - first >= rows):
                yield frame.iloc[first:i].reset_index(drop=True)
                total, first = 0, i
            total += n
        yield frame.iloc[first:].reset_index(drop=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of the values (the splitmix64 finaliser)."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Recent(dict):
    """Values by key, made by ``make`` when first asked for. At most twice ``bound`` of those last used are remembered."""

    def __init__(self, make: Callable[[str], object], bound: int):
        super().__init__()
        self.make, self.bound, self.older = make, bound, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.older = {}
        self.clear()


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What an operator keeps in this Python worker from task to task; what others have kept is let go."""
    if owner not in _KEPT:
        _KEPT.clear()
        HASHES.forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _KEPT[owner] = {}
    return _KEPT[owner]


HASHES = Recent(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")), 60_000)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words (runs of letters, digits and ``_``) of a whole text."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x100000001B3)
        out += words[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles; a shorter text is one shingle, an empty one has none."""
    return rolling(words, min(width, len(words))) if len(words) else np.empty(0, np.uint64)


def free_name(name: str, *taken: str) -> str:
    """``name``, or the same with as many underscores behind it as it takes to differ from all others."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def text_batches(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``size`` bytes of text each, and their texts in UTF-8, the last column; nulls are empty.

    A longer text forms a slice by itself.
    """
    for batch in batches:
        texts = batch.column(column).cast(pa.binary()).to_pylist()
        rest = batch.drop_columns([column])
        total, first = 0, 0
        for i, text in enumerate(texts):
            n = len(text) if text else 0
            if i > first and total + n > size:
                yield rest.slice(first, i - first), [t or b"" for t in texts[first:i]]
                total, first = 0, i
            total += n
        if texts:
            yield rest.slice(first), [t or b"" for t in texts[first:]]


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])
