"""Near-duplicate classes by ProbMinHash.

A text is a weighted set of five-word shingles (weight 1 + ln of the count). Each shingle's
arrivals form a Poisson process with its weight as rate; every arrival falls on one of the
signature's registers, and a register keeps the shingle that arrives first. A shingle's process stops
as soon as its next arrival is later than all registers' first ones. Two texts agree in a
register with the probability Jaccard similarity of their sets. Bands of registers
make candidates, which are verified exactly. Large buckets are verified in pairs of bounded chunks,
of which only links between different components leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, free_name, kept, mix, shingles, word_hashes, written

WIDTH = 5
BANDS, ROWS = 16, 4
REGISTERS = BANDS * ROWS
#: Buckets of at most so many texts are compared in full.
SMALL = 16
#: Larger buckets are compared chunk by chunk: texts and bytes of shingles in a chunk, about.
CHUNK_TEXTS, CHUNK_BYTES = 512, 2 << 20
#: Texts of buckets beyond this are first dealt to narrower ones, by such bands and registers in a band: each finds a pair of similarity 0.8 with a chance over 0.999.
COMPARED = 8192
FINER = ((40, 8), (100, 12))
#: Tables with at most so many 16-byte keys may be broadcast (some 40 MB).
BROADCAST_KEYS = 500_000
_UNIT = 1.0 / (1 << 53)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Values in (0, 1] from the upper bits of hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * _UNIT


def signatures(sets: list[np.ndarray], weighs: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """The winning shingle of each register: (sets, registers). Every set has an element at least."""
    n = len(sets)
    element = np.concatenate(sets)
    rate = np.concatenate(weighs)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    state = mix(element)
    time = -np.log(_uniform(state)) / rate
    while len(element):
        state = mix(state ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        cell = owner * registers + (state % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = time == first[cell]
        winner[cell[won]] = element[won]
        # The next arrivals; processes beyond their set's latest register stop.
        state = mix(state)
        time = time - np.log(_uniform(state)) / rate
        on = time <= first.reshape(n, registers).max(axis=1)[owner]
        element, rate, owner, state, time = element[on], rate[on], owner[on], state[on], time[on]
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A hash for each band of each signature: (sets, bands)."""
    parts = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


def similarity(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> float:
    """The larger of two texts' Jaccard similarity and probability Jaccard; of sorted distinct shingles and their counts."""
    if len(x) > len(y):
        x, nx, y, ny = y, ny, x, nx
    if not len(x):
        return 0.0
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = y[place] == x
    shared = int(common.sum())
    jaccard = shared / (len(x) + len(y) - shared)
    if not shared or (nx.max() == 1 and ny.max() == 1):
        return jaccard
    # The sum over common shingles s of 1 / sum_k max(u_k / u_s, v_k / v_s), with all k in the order of u_k / v_k.
    u, v = weights(nx), weights(ny)
    cu, cv = u[common], v[place[common]]
    order = np.argsort(cu / cv, kind="stable")
    cu, cv = cu[order], cv[order]
    below_u, below_v = np.concatenate([[0.0], np.cumsum(cu)]), np.concatenate([[0.0], np.cumsum(cv)])
    split = np.searchsorted(cu / cv, cu / cv, side="right")  # up to here v's share is the larger
    total = (u.sum() - below_u[split]) / cu + (v.sum() - below_v[-1] + below_v[split]) / cv
    return max(jaccard, float((1.0 / total).sum()))


def _bands(sets: list[tuple[np.ndarray, np.ndarray]], bands: int, rows: int) -> list[np.ndarray]:
    """Band hashes of weighted sets; where shingles repeat also those of the unweighted set, so that pairs which are alike in either way meet."""
    registers = bands * rows
    keys = list(band_keys(signatures([x for x, _ in sets], [weights(n) for _, n in sets], registers), bands))
    again = [k for k, (_, n) in enumerate(sets) if n.max() > 1]
    if again:
        plain = band_keys(signatures([sets[k][0] for k in again], [np.ones(len(sets[k][0])) for k in again], registers), bands)
        for k, own in zip(again, plain, strict=True):
            keys[k] = np.union1d(keys[k], own)
    return keys


def _sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept("near duplicates")
    for frame in blocks(frames, "_text", 1_000_000):
        pairs = [np.unique(shingles(word_hashes(t), WIDTH), return_counts=True) for t in frame["_text"]]
        full = [k for k, (x, _) in enumerate(pairs) if len(x)]
        bands: list[np.ndarray | None] = [None] * len(pairs)
        if full:
            for k, keys in zip(full, _bands([pairs[k] for k in full], BANDS, ROWS), strict=True):
                bands[k] = keys
        frame = frame.drop(columns=["_text"])
        frame["bands"] = bands
        yield frame


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in blocks(frames, "_text", 1_000_000):
        sets = [np.unique(shingles(word_hashes(t), WIDTH), return_counts=True) for t in frame["_text"]]
        yield pd.DataFrame({"node": frame["node"], "shingles": [s.tobytes() for s, _ in sets], "counts": [n.astype(np.uint32).tobytes() for _, n in sets]})


def _set(shingle: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(shingle, np.uint64), np.frombuffer(counts, np.uint32)


def _verify(threshold: float):
    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = zip(frame["x"], frame["nx"], frame["y"], frame["ny"], strict=True)
            good = [similarity(*_set(x, nx), *_set(y, ny)) >= threshold - 1e-9 for x, nx, y, ny in sets]
            yield frame.loc[good, ["a", "b"]]

    return check


def _banded(bands: int, rows: int):
    """Band hashes of longer signatures, for texts whose buckets stayed large."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), 256):
                part = frame.iloc[first : first + 256]
                sets = [_set(*s) for s in zip(part["shingles"], part["counts"], strict=True)]
                yield pd.DataFrame({"node": part["node"], "bands": _bands(sets, bands, rows)})

    return sign


def links(sets: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, own: np.ndarray, theirs: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs (of ``own`` and ``theirs``, indexes of the texts) of the threshold or more that join texts of different labels.

    No pair within a label is given, nor one that earlier pairs make needless, so they are fewer than the labels. What texts share is
    counted through postings: each text of ``own`` with all of ``theirs`` at once.
    """
    labels = labels.copy()
    size = np.array([len(x) for x, _ in sets])
    weighed = [weights(n) for _, n in sets]
    whole = np.array([w.sum() for w in weighed])
    uneven = whole > size  # some shingle repeats
    value = np.concatenate([sets[k][0] for k in theirs])
    owner = np.repeat(np.arange(len(theirs)), size[theirs])
    order = np.argsort(value, kind="stable")
    value, owner, weight = value[order], owner[order], np.concatenate([weighed[k] for k in theirs])[order]
    begins = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    distinct, ends = value[begins], np.append(begins[1:], len(value))
    out = []
    for k, a in enumerate(own.tolist()):
        wanted = labels[theirs] != labels[a]
        if own is theirs:
            wanted[: k + 1] = False
        if not wanted.any():
            continue
        x = sets[a][0]
        at = np.minimum(np.searchsorted(distinct, x), len(distinct) - 1)
        known = distinct[at] == x
        at = at[known]
        many = ends[at] - begins[at]
        place = np.arange(many.sum()) + np.repeat(begins[at] - np.cumsum(many) + many, many)
        met = owner[place]
        shared = np.bincount(met, minlength=len(theirs))
        good = wanted & (shared >= (threshold - 1e-9) * (size[a] + size[theirs] - shared))
        maybe = wanted & ~good & (shared > 0) & (uneven[a] | uneven[theirs])
        if maybe.any():
            # A shared shingle gives no more to the probability Jaccard than its share in either text.
            mine = np.bincount(met, np.repeat(weighed[a][known], many), len(theirs)) / whole[a]
            other = np.bincount(met, weight[place], len(theirs)) / whole[theirs]
            maybe &= np.minimum(mine, other) >= threshold - 1e-9
        near = theirs[good]
        for b in [*near[np.unique(labels[near], return_index=True)[1]].tolist(), *theirs[maybe].tolist()]:
            if labels[a] != labels[b] and similarity(*sets[a], *sets[b]) >= threshold - 1e-9:
                out.append((a, b))
                labels[labels == labels[b]] = labels[a]
    return out


def _linked(threshold: float):
    """The links of a pair of chunks, or of a chunk with itself."""

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        labels = pd.factorize(frame["label"])[0]
        found: list[tuple[int, int]] = []
        if labels.max(initial=0):
            sets = [_set(*s) for s in zip(frame["shingles"], frame["counts"], strict=True)]
            one, two = (np.flatnonzero(frame["chunk"] == frame[c].iloc[0]) for c in ("one", "two"))
            if frame["one"].iloc[0] == frame["two"].iloc[0]:
                two = one
            if len(one) and len(two):
                found = links(sets, labels, one, two, threshold)
        return pd.DataFrame({"a": [frame["node"].iloc[a] for a, _ in found], "b": [frame["node"].iloc[b] for _, b in found]})

    return link


def _key(text: str):
    """128 bits of the text's SHA-256; a null text counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the edges (a, b): the smallest node that each can reach.

    Every round takes the smallest label among neighbours and then that label's own label, so
    that long chains shrink by doubling. Each round's labels are written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        moved = least.join(jump, least["least"] == jump["via"], "left").select("node", F.least("least", "further").alias("label"), (F.least("least", "further") < F.col("label")).alias("changed"))
        made = written(moved, "labels")
        labels = made.select("node", "label")
        if not made.where("changed").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """One row for each input row: doc_id, class_id (the smallest id of its class), text_key and kept.

    Rows with the same text are one node; nodes are linked when their similarity (the larger of
    shingle-set Jaccard and probability Jaccard) is ``threshold`` or more, and classes are the connected
    components. A text with fewer than five words is one shingle of all its words; texts
    without words, null ones among them, are linked to equal texts only. kept marks one row
    of each class: the one with the smallest id (nulls last), and of repeated rows of that id one that
    is chosen by its text. Null ids are allowed; class_id is null only where a class has no other id.
    Other columns take no part.

    Candidates: texts of one bucket, that is with one band hash. A first round verifies one candidate of each
    text, its bucket's smallest; a second one those pairs of small buckets (up to 16 texts) that are still in different components.
    Larger buckets that still hold several components are compared in full between these, in pairs of chunks, whose
    rows are bounded and of which only links leave. Those of more than 8192 texts are dealt to narrower buckets by longer
    signatures first, twice; what is then still larger is compared in full as well.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("node", _key("_text"))
    signed = base.mapInPandas(_sign, "id bigint, node binary, bands array<bigint>")
    texts = written(signed.groupBy("node").agg(F.min("id").alias("first"), F.first("bands").alias("bands")), "texts")
    members = _members(texts.select("node", "bands"))

    wanted = members.select("node").distinct().persist()
    few = wanted.count() <= BROADCAST_KEYS
    chosen = base.join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    # One row of each text: the first id's (several only where that row is repeated).
    firsts = texts.select(F.col("node").alias("_node"), F.col("first").alias("_first")).join(F.broadcast(wanted) if few else wanted, F.col("_node") == wanted["node"], "left_semi")
    one = chosen.join(F.broadcast(firsts) if few else firsts, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_first"))).select("node", "_text")
    listed = written(one.mapInPandas(_listed, "node binary, shingles binary, counts binary").dropDuplicates(["node"]), "shingles")
    wanted.unpersist()

    def verified(pairs: DataFrame) -> DataFrame:
        x = listed.select(F.col("node").alias("a"), F.col("shingles").alias("x"), F.col("counts").alias("nx"))
        y = listed.select(F.col("node").alias("b"), F.col("shingles").alias("y"), F.col("counts").alias("ny"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "nx", "y", "ny").mapInPandas(_verify(threshold), "a binary, b binary")

    star = members.where(F.col("node") != F.col("head"))
    nearest = star.groupBy("node").agg(F.min("head").alias("b")).select(F.col("node").alias("a"), "b")
    edges = written(verified(nearest), "links")
    labels = components(edges)
    edges, labels = _extended(edges, labels, _candidates(members).join(nearest, ["a", "b"], "left_anti"), verified)

    for finer in (*FINER, None):
        large = written(_unsettled(members, labels, listed), "large")
        now = large if finer is None else large.where(F.col("n") <= COMPARED)
        edges, labels = _joined(edges, labels, _compared(now, listed, threshold))
        if finer is None or not large.where(F.col("n") > COMPARED).limit(1).count():
            break
        left = large.where(F.col("n") > COMPARED).select("node").distinct()
        members = _members(listed.join(left, "node", "left_semi").mapInPandas(_banded(*finer), "node binary, bands array<bigint>"))
        edges, labels = _extended(edges, labels, _candidates(members), verified)

    named = texts.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Most classes are small, and minima are taken in each task first.
    lead = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("s"))
    named = named.join(lead.select("label", F.col("s.first").alias("class_id"), F.col("s.node").alias("lead")), "label")
    return _rows(base.select("id", "node"), named.select("node", "first", "class_id", "lead"), doc_id)


def _members(signed: DataFrame) -> DataFrame:
    """(bucket, node, head, n) for buckets of two or more; head is the smallest node."""
    spread = written(signed.where("bands is not null").select(F.explode("bands").alias("bucket"), "node"), "bands")
    counted = spread.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(spread.join(counted, "bucket"), "members")


def _candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): each text with its bucket's head, and in small buckets all others."""
    star = members.where(F.col("node") != F.col("head")).select(F.col("node").alias("a"), F.col("head").alias("b"))
    small = members.where((F.col("n") > 2) & (F.col("n") <= SMALL)).where(F.col("node") != F.col("head")).select("bucket", F.col("node").alias("a"))
    inside = small.join(small.select("bucket", F.col("a").alias("b")), "bucket").where(F.col("a") > F.col("b")).select("a", "b")
    return star.union(inside).distinct()


def _unsettled(members: DataFrame, labels: DataFrame, listed: DataFrame) -> DataFrame:
    """The members, with their labels and chunks, of large buckets that hold several components."""
    sizes = listed.select("node", F.length("shingles").alias("bytes"))
    large = members.where(F.col("n") > SMALL).select("bucket", "node", "n").join(sizes, "node").join(labels, "node", "left")
    large = large.withColumn("label", F.coalesce("label", "node"))
    mixed = large.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("n").alias("n"), F.sum("bytes").alias("bytes")).where("low < high")
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK_TEXTS, F.col("bytes") / CHUNK_BYTES)).cast("int").alias("chunks")
    joined = large.select("bucket", "node", "label", "n").join(mixed.select("bucket", chunks), "bucket")
    return joined.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def _compared(large: DataFrame, listed: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the components of each bucket. Every text meets its bucket's chunks one by one, each meeting a group of its own."""
    met = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("bucket", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "node", "label")
    return met.join(listed, "node").groupBy("bucket", "one", "two").applyInPandas(_linked(threshold), "a binary, b binary")


def _extended(edges: DataFrame, labels: DataFrame, pairs: DataFrame, verified) -> tuple[DataFrame, DataFrame]:
    """The edges and labels with those of the pairs added that lie in different components and verify."""
    one, two = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    apart = pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    return _joined(edges, labels, verified(apart))


def _joined(edges: DataFrame, labels: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges and labels with the found links added."""
    new = written(found.distinct(), "links")
    if not new.limit(1).count():
        return edges, labels
    edges = written(edges.union(new), "links")
    return edges, components(edges)


def _rows(rows: DataFrame, named: DataFrame, doc_id: str) -> DataFrame:
    """Each input row with its text's class; one row of the lead text that has the class's id is kept.

    Texts of many rows would gather in one task of a join, so their few keys (a thousandth of
    all rows each, hence a thousand at most) are answered by broadcast.
    """
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counts = written(counts, "copies")
    total = rows.count()
    hot = named.join(F.broadcast(counts.where(F.col("c") > max(1000, total / 1000)).select("node")), "node", "left_semi")
    hot = F.broadcast(hot.select(F.col("node").alias("hot"), F.struct("first", "class_id", "lead").alias("hs")))
    first = rows.join(hot, rows["node"] == F.col("hot"), "left")
    key = F.when(F.col("hot").isNull(), F.col("node")).otherwise(F.unhex(F.hex(F.xxhash64("id"))))
    cold = named.select(F.col("node").alias("k"), F.struct("first", "class_id", "lead").alias("cs"))
    out = first.withColumn("k", key).join(cold, "k", "left").withColumn("s", F.coalesce("hs", "cs"))
    leads = (F.col("node") == F.col("s.lead")) & F.col("id").eqNullSafe(F.col("s.class_id"))
    return out.select(F.col("id").alias(doc_id), F.col("s.class_id").alias("class_id"), F.lower(F.hex("node")).alias("text_key"), leads.alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """The rows of docs that ``near_duplicates`` keeps, one for each class, with all their columns."""
    own, its = free_name("_text_key", *docs.columns), free_name("_id", *docs.columns)
    leads = near_duplicates(docs, text, doc_id, threshold).where("kept").select(F.col(doc_id).cast("bigint").alias(its), F.col("text_key").alias(own)).distinct()
    keyed = docs.withColumn(own, F.lower(F.hex(_key(text))))
    rows = keyed.join(leads, F.col(doc_id).cast("bigint").eqNullSafe(F.col(its)) & (keyed[own] == leads[own]), "left_semi").select(*docs.columns, own)
    return rows.dropDuplicates([own, doc_id]).select(*docs.columns)
