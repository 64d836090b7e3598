"""Quality scores from compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text resembles
the class whose dictionary compresses it better: the difference of its two compressed sizes,
in parts of their sum, becomes a probability by a logistic calibration, which also sees how
far the text compresses at all (text that only repeats itself has two tiny sizes).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, first_by_hash

LEVEL = 3
BLOCK = 2048


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of both classes and the calibration: p = 1 / (1 + exp(-(weights . (difference, log ratio) + bias)))."""

    good: bytes
    bad: bytes
    weights: tuple[float, float]
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.bias, -700, 700)))


class _Sizes:
    """Compressed sizes of whole texts under both dictionaries, in blocks so that the dictionary and not the text itself tells."""

    def __init__(self, good: bytes, bad: bytes):
        self.coders = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO),
                write_content_size=False,
                write_dict_id=False,
            )
            if data
            else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            for data in (good, bad)
        ]

    def features(self, texts: Iterable[str]) -> np.ndarray:
        """For each text (bad size - good size) / (their sum), and the log of their mean over its bytes; 0, 0 for an empty text."""
        out = []
        for text in texts:
            data = text.encode("utf-8", "surrogatepass")
            parts = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
            good, bad = (sum(len(c.compress(x)) for x in parts) for c in self.coders)
            out.append(((bad - good) / (bad + good), math.log((bad + good) / (2 * len(data)))) if data else (0.0, 0.0))
        return np.array(out).reshape(-1, 2)


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary of whole texts; too little text to train on serves as it is."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = [x for x in data if x]
    try:
        return zstandard.train_dictionary(size, data, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(data)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Weights and bias by Newton steps with a small ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    design = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.array([1e-2] * x.shape[1] + [1e-9])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(curve, design.T @ (weight * (y - p)) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in beta[:-1] / scale), float(beta[-1])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    per_class: int = 1500,
    max_chars: int = 16_000,
    dictionary_bytes: int = 112_640,
) -> QualityModel:
    """Learns from a bounded sample of labelled rows.

    The sample: the ``per_class`` labelled ids of each class first in hash order whose text has at
    most ``max_chars`` characters. Three in five fill the dictionaries, the others calibrate;
    the calibration weighs classes as all labels do. An id with several labels takes
    the smallest; null ids, labels other than 0 and 1, and null texts are not used. Without
    labels the model gives 0.5 always, with one class alone that class's share of 1.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_label").alias("_label"))
    shares = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    # Twice as many ids as needed: some texts are missing, null or too long.
    first = [first_by_hash(known.where(F.col("_label") == k), 2 * per_class, "_id") for k in (0, 1)]
    ids = first[0].unionByName(first[1])
    found = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
        .where(F.length("_text") <= max_chars)
        .join(F.broadcast(ids), "_id")
        .groupBy("_label", "_h", "_id")
        .agg(F.min("_text").alias("_text"))
    )
    rows = found.toPandas().sort_values(["_label", "_h", "_id"]).groupby("_label").head(per_class)
    rows["_k"] = rows.groupby("_label").cumcount()
    if not len(rows) or len(shares) < 2:
        one = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
        one = min(max(one, 1e-6), 1 - 1e-6)
        return QualityModel(b"", b"", (0.0, 0.0), float(np.log(one / (1 - one))))
    teach = rows["_k"] % 5 < 3
    good, bad = (_dictionary(list(rows["_text"][teach & (rows["_label"] == k)]), dictionary_bytes) for k in (1, 0))
    rest = rows[~teach] if {*rows["_label"][~teach]} == {0, 1} else rows
    x = _Sizes(good, bad).features(rest["_text"])
    y = rest["_label"].to_numpy(float)
    weight = np.where(y == 1, shares[1] / max(1, y.sum()), shares[0] / max(1, (1 - y).sum()))
    weights, bias = _logistic(x, y, weight * len(y) / weight.sum())
    return QualityModel(good, bad, weights, bias)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's ``keep`` columns with difference and score, the probability of label 1.

    One output row per input row, repeated rows and null ids included. Whole texts are compressed,
    in blocks of 2 KB; a null text counts as empty, whose difference is 0 (its score is the
    calibration's bias). Other columns take no part.
    """
    rows = docs.select(*keep, F.col(text).alias("_read"))
    schema = rows.select(*keep).schema.add("difference", "double").add("score", "double")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = _Sizes(model.good, model.bad)
        for frame in blocks(frames, "_read", 4_000_000):
            x = sizes.features(frame["_read"])
            frame = frame.drop(columns=["_read"])
            frame["difference"] = x[:, 0]
            frame["score"] = model.probability(x)
            yield frame

    return rows.mapInPandas(score, schema)
