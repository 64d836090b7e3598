"""Codes of vectors by product quantisation, with exact k-means over metric trees of the anchors hierarchy.

Each part of the vectors has a codebook of its own. Rows are held in blocks; each block has one tree of balls for each
part, built once from the middle out: anchors are chosen furthest first and take over points nearer to them, using the triangle inequality on
sorted lists; the anchors' balls are joined upwards, the pair that makes the smallest ball first, and split downwards in the same way.
A ball caches the sum and the number of its points. A round walks down the trees with the list of the entries that can be
nearest to any point of a ball, which a ball inherits from the one above it and shortens; a ball with one entry left is wholly
owned, and its cached sum and number are all that the round needs of it. Sums of rounds are added up by Spark.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK_ROWS = 2048
LEAF_ROWS = 24
#: Scaled components beyond this count as this: sums and distances stay within what integers of Spark can hold.
LIMIT = 1 << 60
#: Labels that are sent to all tasks at most; beyond, those with the most rows.
SENT_LABELS = 1000
_LONG = (1 << 63) - 1


def scaled(vectors: list, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of all components, in the narrowest integers that hold them; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(out * scale), -float(LIMIT), float(LIMIT)).astype(np.int64)
    return x.astype(np.min_scalar_type(-int(np.abs(x).max(initial=0)) - 1))


def exact_floats(*arrays: np.ndarray) -> bool:
    """Whether double precision holds all squared distances between the rows, and what adds up to them, exactly."""
    top = max(int(np.abs(a).max(initial=0)) for a in arrays)
    return 16 * top * top * max(1, arrays[0].shape[1]) < 1 << 53


@dataclass
class Tree:
    """Balls in an array, a ball's halves after itself: pivot, radius, its points as a range of ``order``, their sum and number."""

    order: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sums: np.ndarray


class _Ball:
    __slots__ = ("pivot", "radius", "points", "left", "right", "n")

    def __init__(self, pivot, radius, n, points=None, left=None, right=None):
        self.pivot, self.radius, self.n, self.points, self.left, self.right = pivot, radius, n, points, left, right


def _anchors(x: np.ndarray, points: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(points, distances) of at most ``count`` anchors, each list by falling distance; one if all points are the same."""
    far = np.sqrt(((x[points] - x[points[0]]) ** 2).sum(axis=1))
    order = np.argsort(-far, kind="stable")
    lists = [(points[order], far[order])]
    at = [points[0]]
    while len(lists) < count:
        widest = max(range(len(lists)), key=lambda k: lists[k][1][0])
        own, radii = lists[widest]
        if radii[0] == 0:
            break
        new = own[0]
        got, got_far = [], []
        for k, (mine, dist) in enumerate(lists):
            between = np.sqrt(((x[at[k]] - x[new]) ** 2).sum())
            # A point within half of the anchors' distance is nearer to its own: the rest of the list needs no look.
            reach = int(np.searchsorted(-dist, -between / 2, side="right"))
            if not reach:
                continue
            there = np.sqrt(((x[mine[:reach]] - x[new]) ** 2).sum(axis=1))
            moves = there < dist[:reach]
            if moves.any():
                got.append(mine[:reach][moves])
                got_far.append(there[moves])
                stay = np.concatenate([~moves, np.ones(len(mine) - reach, bool)])
                lists[k] = mine[stay], dist[stay]
        mine, dist = np.concatenate(got), np.concatenate(got_far)
        order = np.argsort(-dist, kind="stable")
        lists.append((mine[order], dist[order]))
        at.append(new)
    return lists


def _joined(balls: list[_Ball]) -> _Ball:
    """One ball over all, joined in pairs, the pair with the smallest common ball first."""
    n = len(balls)
    pivots, radii, sizes = np.array([b.pivot for b in balls]), np.array([b.radius for b in balls]), np.array([b.n for b in balls], float)

    def common(k: int) -> tuple[np.ndarray, np.ndarray]:
        share = (sizes / (sizes + sizes[k]))[:, None]
        middle = pivots * share + pivots[k] * (1 - share)
        both = np.maximum(np.sqrt(((middle - pivots) ** 2).sum(axis=1)) + radii, np.sqrt(((middle - pivots[k]) ** 2).sum(axis=1)) + radii[k])
        return middle, both

    cost = np.full((n, n), np.inf)
    for k in range(n):
        cost[k] = common(k)[1]
        cost[k, k] = np.inf
    for _ in range(n - 1):
        a, b = divmod(int(cost.argmin()), n)
        middle, both = common(a)
        made = _Ball(middle[b], both[b], balls[a].n + balls[b].n, None, balls[a], balls[b])
        balls[a], pivots[a], radii[a], sizes[a] = made, made.pivot, made.radius, made.n
        cost[b], cost[:, b] = np.inf, np.inf
        gone = np.isinf(cost[a])
        fresh = common(a)[1]
        fresh[gone] = np.inf
        fresh[a] = np.inf
        cost[a], cost[:, a] = fresh, fresh
        last = made
    return last if n > 1 else balls[0]


def _split(x: np.ndarray, points: np.ndarray) -> _Ball:
    pivot = x[points].mean(axis=0) if len(points) else np.zeros(x.shape[1])
    radius = float(np.sqrt(((x[points] - pivot) ** 2).sum(axis=1)).max(initial=0.0))
    leaf = _Ball(pivot, radius, len(points), points)
    if len(points) <= LEAF_ROWS:
        return leaf
    lists = _anchors(x, points, int(np.ceil(np.sqrt(len(points)))))
    return leaf if len(lists) == 1 else _joined([_split(x, own) for own, _ in lists])


def build_tree(x: np.ndarray) -> Tree:
    """The tree of the rows of ``x``; a single ball where double precision would not be exact."""
    values = x.astype(np.float64)
    everything = np.arange(len(x))
    root = _split(values, everything) if exact_floats(x) else _Ball(np.zeros(x.shape[1]), np.inf, len(x), everything)
    rows, order, at = [], [], 0
    stack = [(root, None)]
    while stack:
        ball, above = stack.pop()
        k = len(rows)
        rows.append([ball.pivot, ball.radius * (1 + 1e-9) + 1e-9, at, at + ball.n, -1, -1])
        if above is not None:
            rows[above][4 if rows[above][4] < 0 else 5] = k
        if ball.points is None:
            stack += [(ball.right, k), (ball.left, k)]
        else:
            order.append(ball.points)
            at += ball.n
    order = np.concatenate(order)
    pivot, radius, start, stop, left, right = (np.array(c) for c in zip(*rows))
    total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[order].astype(np.int64), axis=0)]) if exact_floats(x) else np.concatenate([np.zeros((1, x.shape[1]), object), np.cumsum(x[order].astype(object), axis=0)])
    return Tree(order, pivot.reshape(len(rows), x.shape[1]), radius, start, stop, left, right, total[stop] - total[start])


def _nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The first of the nearest entries of each point, exactly."""
    if exact_floats(points, entries):
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((e * e).sum(axis=1) - 2 * p @ e.T).argmin(axis=1)
    p, e = points.astype(object), entries.astype(object)
    return np.array([((e - row) ** 2).sum(axis=1).argmin() if e.shape[1] else 0 for row in p], np.int64)


def assign(tree: Tree, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], list[np.ndarray]]:
    """The nearest entry of each row of ``x``, ties to the lower index; the balls that one entry wholly owns (ball, entry); the rows of all others."""
    # Of equal entries only the first can own anything.
    _, first = np.unique(entries, axis=0, return_index=True) if entries.shape[1] else (None, np.array([0]))
    first = np.sort(first)
    own = entries[first]
    exact = exact_floats(x, own)
    e = own.astype(np.float64)
    between = np.sqrt(np.maximum(((e[:, None] - e[None]) ** 2).sum(axis=2), 0)) if exact else None
    owner = np.empty(len(x), np.int64)
    balls, looked = [], []
    front, listed = np.array([0]), np.ones((1, len(own)), bool)
    while len(front):
        if exact:
            p = tree.pivot[front]
            d2 = np.maximum((p * p).sum(axis=1)[:, None] - 2 * p @ e.T + (e * e).sum(axis=1), 0)
            best = np.where(listed, d2, np.inf).argmin(axis=1)
            least = d2[np.arange(len(front)), best][:, None]
            # Over a ball, |x - entry|^2 - |x - best|^2 is at least that at the pivot less 2 radius |entry - best|.
            surely = d2 - least - 2 * tree.radius[front][:, None] * between[best] > 1e-9 * (1 + d2 + least + (p * p).sum(axis=1)[:, None])
            listed = listed & ~surely
        single = listed.sum(axis=1) == 1
        for ball, entry in zip(front[single], listed[single].argmax(axis=1)):
            balls.append((int(ball), int(first[entry])))
            owner[tree.order[tree.start[ball] : tree.stop[ball]]] = first[entry]
        below = ~single & (tree.left[front] >= 0)
        for k in np.flatnonzero(~single & ~below):
            rows = tree.order[tree.start[front[k]] : tree.stop[front[k]]]
            candidates = np.flatnonzero(listed[k])
            owner[rows] = first[candidates[_nearest(x[rows], own[candidates])]]
            looked.append(rows)
        front, listed = np.concatenate([tree.left[front[below]], tree.right[front[below]]]), np.concatenate([listed[below], listed[below]])
    return owner, balls, looked


def round_sums(tree: Tree, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the rows nearest to each entry; wholly owned balls give what they have cached."""
    owner, balls, looked = assign(tree, x, entries)
    wide = tree.sums.dtype == object
    sums, counts = np.zeros(entries.shape, object if wide else np.int64), np.zeros(len(entries), np.int64)
    if balls:
        ball, entry = np.array(balls).T
        np.add.at(sums, entry, tree.sums[ball])
        np.add.at(counts, entry, (tree.stop - tree.start)[ball])
    if looked:
        rows = np.concatenate(looked)
        np.add.at(sums, owner[rows], x[rows].astype(sums.dtype))
        counts += np.bincount(owner[rows], minlength=len(entries))
    return sums, counts


def errors(x: np.ndarray, owner: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to their entries."""
    apart = x.astype(np.int64) - entries[owner]
    if exact_floats(x, entries):
        return (apart * apart).sum(axis=1)
    apart = x.astype(object) - entries[owner].astype(object)
    return np.array([sum(int(a) ** 2 for a in row) for row in apart], object)


def _blocks(rows: DataFrame, width: int, label_type: str) -> DataFrame:
    """(ids, labels, block): rows of every input partition in blocks, with the scaled parts and their trees."""
    part = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(first, BLOCK_ROWS)
                x = scaled(own.column("v").to_numpy(zero_copy_only=False).tolist(), width)
                parts = [np.ascontiguousarray(x[:, k * part : (k + 1) * part]) for k in range(PARTS)]
                block = pickle.dumps([(p, build_tree(p)) for p in parts], protocol=5)
                ids, labels = (pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(c)) for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([block], pa.binary())], names=["ids", "labels", "block"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"ids array<bigint>, labels array<{label_type}>, block binary")


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round; each task sends one row for each entry that has points, whatever the number of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for block in batch.column("block"):
                for k, (x, tree) in enumerate(pickle.loads(block.as_py())):
                    more, n = round_sums(tree, x, books[k])
                    used = np.flatnonzero(n)
                    sums[k][used] += more[used].astype(object)
                    counts[k] += n
        rows = [(k, int(e), int(counts[k][e]), [str(s) for s in sums[k][e]]) for k in range(len(books)) for e in np.flatnonzero(counts[k])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) if j < 3 else pa.array(c, pa.list_(pa.string())) for j, c in enumerate(zip(*rows))], names=["part", "entry", "n", "sums"])

    partial = blocks.select("block").mapInArrow(run, "part bigint, entry bigint, n bigint, sums array<string>")
    numbers = partial.withColumn("sums", F.col("sums").cast("array<decimal(38,0)>"))
    width = books[0].shape[1]
    added = numbers.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
    new = [b.copy() for b in books]
    for row in added.collect():  # at most one row for each entry of each codebook
        new[row.part][row.entry] = [int(s) // row.n for s in row.sums]
    return new


def _coded(blocks: DataFrame, books: list[np.ndarray], label_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes, error = [], 0
                for j, (x, tree) in enumerate(pickle.loads(batch.column("block")[k].as_py())):
                    owner, _, _ = assign(tree, x, books[j])
                    codes.append(owner.astype(np.uint8))
                    error = error + errors(x, owner, books[j])
                names = [row.tobytes().hex() for row in np.stack(codes, axis=1)]
                held = [min(int(e), _LONG) for e in error]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(names, pa.string()), pa.array(held, pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id bigint, label {label_type}, code string, error bigint")


def _label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of error over equal labels; a label with many rows is joined without moving them."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = written(coded.groupBy("label").agg(F.least(total, F.lit(_LONG).cast("decimal(38,0)")).cast("bigint").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    large = sums.orderBy(F.desc("_n"), "label").limit(SENT_LABELS).select(F.col("label").alias("_label"), "label_error")
    sent = coded.join(F.broadcast(large), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    if sums.count() <= SENT_LABELS:
        return sent
    rest = sums.select(F.col("label").alias("_label"), F.col("label_error").alias("_other"))
    others = sent.where("label_error is null").join(rest, F.col("label").eqNullSafe(F.col("_label")), "left")
    return sent.where("label_error is not null").unionByName(others.select("vec_id", "label", "code", "error", F.col("_other").alias("label_error")))


def encode(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of all rows whose vector is whole.

    Rows with a null vector or a null, infinite or NaN component are dropped. Components become floor(1024 x); vectors are cut into four
    parts of equal width, shorter ones and widths that four doesn't divide after zeros at the end. Codebooks start with the parts of the
    ``entries`` (256 at most) smallest ids, repeated ids by their vectors, null ids last; with fewer rows they are shorter. Each round moves an entry to the
    floor of its points' mean; entries without points stay. code: two hex digits for each part; error: squared distances, summed over
    parts; label_error: over all rows of a label, nulls together. Values beyond 2^60 after scaling count as that, errors beyond a long as the
    largest. Repeated rows are coded each; an empty table gives no rows; other columns take no part.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label_type = rows.schema[label].dataType.simpleString()
    kept = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    widest = kept.agg(F.max(F.size("v"))).first()[0]
    if widest is None:
        return rows.sparkSession.createDataFrame([], f"vec_id bigint, label {label_type}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    width = -(-widest // PARTS) * PARTS
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    start = scaled([r.v for r in seeds], width).astype(np.int64)
    books = np.split(start, PARTS, axis=1)
    blocks = written(_blocks(kept, width, label_type), "vector-blocks")
    for _ in range(rounds):
        books = _round(blocks, books)
    digest = hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()
    coded = written(_coded(blocks, books, label_type), "vector-codes")
    return _label_errors(coded).withColumn("codebooks_sha256", F.lit(digest))
