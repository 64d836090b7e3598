"""A hidden Markov language model over words.

Words that are frequent in the training texts are symbols of their own; all others share
symbols by their last two characters. Hidden states emit symbols, and a symbol its word by the
word's smoothed share of it, so that all words, unknown ones included, together have
probability 1 in every state. Baum-Welch expectations are computed in each partition and
summed; the scaled forward recursion gives each text's exact likelihood.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, written

STATES = 8
SYMBOLS = 16_384
SUFFIXES = 1_024
#: The most frequent words, which are sent with the tasks; the counts of all others are joined.
SENT_WORDS = 100_000
ITERATIONS = 2
#: Tokens that a task lays side by side; a longer text is taken alone.
HELD_TOKENS = 2_000_000
#: Tokens whose recursion values are held at once in training, and steps between two rescalings.
RUN_TOKENS, RESCALED = 200_000, 8
_SPLIT = "[ \\t-\\r]+"
_END = 0  # symbol of the end of a text; words follow, then suffix classes


def words_of(text: Column) -> Column:
    """The words of a text: lower-cased in A-Z only, cut at spaces and the characters U+0009 to U+000D."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _SPLIT), lambda w: w != "")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(text: str) -> list[bytes]:
    """The same words as UTF-8; bytes are split at just these six characters."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the training tokens. ``sent``: the most frequent words and their counts, most frequent first.

    ``total``: all tokens, ends included; ``ends``: how many of them; ``distinct``: different tokens, the end
    included. ``class_tokens`` and ``class_words``: tokens and different words of each suffix class.
    """

    sent: tuple[tuple[str, int], ...]
    total: int
    ends: int
    distinct: int
    symbols: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    @property
    def width(self) -> int:
        return 1 + self.symbols + SUFFIXES

    @property
    def class_sizes(self) -> np.ndarray:
        """What a smoothed count is divided by for a word's share of its suffix class."""
        return self.class_tokens + 0.1 * (self.class_words + 1)


def _suffix(word: bytes) -> int:
    """The class of a word's last two characters; ``suffix_of`` is the same for a column."""
    return zlib.crc32(word[-8:].decode("utf-8", "ignore")[-2:].encode()) % SUFFIXES


def suffix_of(word: Column) -> Column:
    return F.pmod(F.crc32(F.right(word, F.lit(2))), F.lit(SUFFIXES)).cast("int")


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over whole texts, written to the shared folder; counts are combined in each task before the shuffle."""
    words = docs.select(F.explode(words_of(F.col(text))).alias("word"))
    return written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")


def vocabulary(counts: DataFrame, ends: int, symbols: int = SYMBOLS, sent: int = SENT_WORDS) -> Vocabulary:
    """The model's vocabulary of all training words; at most ``sent`` words and one row for each suffix class are collected."""
    rarest = _rarest_sent(counts, max(sent, symbols))
    top = sorted(((r["word"], r["n"]) for r in counts.where(F.col("n") >= rarest).collect()), key=lambda x: (-x[1], x[0]))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    classes = counts.groupBy(suffix_of(F.col("word")).alias("suffix")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w"))
    tokens, words = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in classes.collect():
        tokens[r["suffix"]], words[r["suffix"]] = r["n"], r["w"]
    for word, n in top[:symbols]:  # these are not in their suffix class
        k = _suffix(word.encode())
        tokens[k] -= n
        words[k] -= 1
    own = min(symbols, len(top))
    return Vocabulary(tuple(top), total + ends, ends, distinct + (ends > 0), own, tokens, words)


def _rarest_sent(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, from how many words have each count; words are not sorted."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(most).collect()
    total, least = 0, 1 << 62
    for r in sizes:
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    return least


class _Reader:
    """Texts as symbol sequences."""

    def __init__(self, held: Vocabulary):
        self.held = held
        self.known = {w.encode(): k for k, (w, _) in enumerate(held.sent)}
        count = np.array([c for _, c in held.sent], np.int64)
        n = held.symbols
        classes = np.array([_suffix(w) for w in list(self.known)[n:]], np.int64)
        # By rank, and last for words that are not sent: symbol, base score, log10 share of the class.
        self.symbol = np.concatenate([np.arange(1, n + 1), 1 + n + classes, [0]]).astype(np.int32)
        self.base = np.append(held.base(count), 0.0)
        self.share = np.concatenate([np.zeros(n), np.log10((count[n:] + 0.1) / held.class_sizes[classes]), [0.0]])
        self.suffix: dict[bytes, int] = {}

    def class_symbol(self, word: bytes) -> int:
        tail = word[-2:]
        if not tail.isascii():  # a character of several bytes
            tail = word[-8:]
        value = self.suffix.get(tail)
        if value is None:
            if len(self.suffix) > 200_000:
                self.suffix.clear()
            value = self.suffix[tail] = 1 + self.held.symbols + _suffix(tail)
        return value

    def read(self, text: str) -> tuple[bytes, int, float, float, str]:
        """Symbols, the end included, as 16-bit integers; over the words that are sent how many, their base score and their log10 shares of their classes; and the other words, joined by spaces."""
        words = _words(text)
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        out = np.empty(len(words) + 1, "<u2")
        out[:-1] = self.symbol[at]
        out[-1] = _END
        rare = [words[k] for k in np.flatnonzero(at < 0).tolist()]
        if rare:
            out[:-1][at < 0] = [self.class_symbol(w) for w in rare]
        return out.tobytes(), len(words) - len(rare), float(self.base[at].sum()), float(self.share[at].sum()), b" ".join(rare).decode("utf-8", "replace")


def tokenised(docs: DataFrame, held: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's ``keep`` columns and its whole text as symbols, read once and written to the shared folder.

    A null text is the end alone. Other columns: _row (a number of the row's own), _symbols, _rare (the words that are not
    sent), _n, _base and _share (sums over the sent ones and the end).
    """
    if held.width > 1 << 16:
        raise ValueError(f"{held.width} symbols do not fit 16 bits")
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema
    for name, kind in (("_symbols", "binary"), ("_n", "long"), ("_base", "double"), ("_share", "double"), ("_rare", "string")):
        schema = schema.add(name, kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(held)
        end = float(held.base(np.array([held.ends]))[0])
        for frame in blocks(frames, "_text", 1_000_000):
            parts = [reader.read(t) for t in frame["_text"]]
            frame = frame.drop(columns=["_text"])
            frame["_symbols"] = [p[0] for p in parts]
            frame["_n"] = [p[1] + (held.ends > 0) for p in parts]
            frame["_base"] = [p[2] + end for p in parts]
            frame["_share"] = [p[3] for p in parts]
            frame["_rare"] = [p[4] for p in parts]
            yield frame

    return written(rows.mapInPandas(run, schema).withColumn("_row", F.monotonically_increasing_id()), "symbols")


def _sequences(frames: Iterable[pd.DataFrame], most: int = HELD_TOKENS) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows of about ``most`` tokens, without their symbols, and these."""
    for frame in frames:
        if not len(frame):
            continue
        part = np.cumsum([len(s) // 2 for s in frame["_symbols"]]) // most
        for own in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(part)) + 1):
            rows = frame.iloc[own].reset_index(drop=True)
            yield rows.drop(columns=["_symbols"]), [np.frombuffer(s, "<u2") for s in rows["_symbols"]]


def _alike(texts: list[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """The sequences, longest first, in runs of at most ``most`` tokens or a single longer one: those of a run are of like length."""
    held, total = [], 0
    for text in sorted(texts, key=len, reverse=True):
        if held and total + len(text) > most:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


@dataclass(frozen=True)
class HiddenMarkov:
    """start (states), move (states, states) and emit (states, symbols); rows are distributions."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _columns(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences laid out step by step, longest first: symbols, the first place of each step, and the order."""
    length = np.array([len(t) for t in texts])
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(length.max()), side="left")  # sequences longer than each step
    start = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(start[-1], np.int32)
    for rank, k in enumerate(order):
        flat[start[: length[k]] + rank] = texts[k]
    return flat, start, order


def log_likelihood(model: HiddenMarkov, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole symbol sequence by the scaled forward recursion."""
    flat, start, order = _columns(texts)
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(texts))
    alpha = np.broadcast_to(model.start, (len(texts), len(model.start)))
    for t in range(len(start) - 1):
        n = start[t + 1] - start[t]
        alpha = alpha[:n] if t == 0 else alpha[:n] @ model.move
        alpha = alpha * emit[flat[start[t] : start[t + 1]]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(texts))
    out[order] = total
    return out


def expectations(model: HiddenMarkov, texts: list[np.ndarray], most: int = RUN_TOKENS) -> HiddenMarkov:
    """Expected counts of starts, moves and emissions in whole sequences, by forward and backward recursion.

    The steps are cut into stretches of about ``most`` tokens. On the way forward each leaves its last step only, and on
    the way back it is run again, so that memory is bounded for a text of any length. Rows are rescaled
    now and then: an expectation is a share, in which a row's scale cancels out.
    """
    states, width = model.emit.shape
    flat, first, _ = _columns(texts)
    alive = np.diff(first)
    emit, back = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    cuts = [0]
    while cuts[-1] < len(alive):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + most, side="right")) - 1))

    def forward(s: int, e: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = first[s]
        seen = emit[flat[low : first[e]]]
        seen /= seen.max(axis=1, keepdims=True)
        alpha = np.empty_like(seen)
        for t in range(s, e):
            own = slice(first[t] - low, first[t + 1] - low)
            now = alpha[own]
            if t:
                np.matmul(before[: len(now)], model.move, out=now)
            else:
                now[:] = model.start
            now *= seen[own]
            if t % RESCALED == 0:
                now /= now.sum(axis=1, keepdims=True)
            before = now
        return seen, alpha

    heads = [np.empty((0, states))]
    for s, e in zip(cuts[:-2], cuts[1:-1], strict=True):
        heads.append(forward(s, e, heads[-1])[1][first[e - 1] - first[s] :].copy())
    start, move, counts = np.zeros(states), np.zeros((states, states)), np.zeros((states, width))
    carry = np.empty((0, states))
    for k in reversed(range(len(heads))):
        s, e = cuts[k], cuts[k + 1]
        low = first[s]
        seen, alpha = forward(s, e, heads[k])
        beta = np.ones_like(alpha)
        beta[first[e - 1] - low :][: len(carry)] = carry
        for t in range(e - 1, s, -1):
            own = slice(first[t] - low, first[t + 1] - low)
            before = beta[first[t - 1] - low :][: alive[t]]
            np.matmul(beta[own] * seen[own], back, out=before)
            if t % RESCALED == 0:
                before /= before.max(axis=1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        if s == 0:
            start = gamma[: first[1]].sum(axis=0)
        own_symbols, gamma = flat[low : first[e]], np.ascontiguousarray(gamma.T)
        counts += np.stack([np.bincount(own_symbols, gamma[j], minlength=width) for j in range(states)])
        beta *= seen
        carry = beta[: alive[s]] @ back
        carry /= carry.max(axis=1, keepdims=True)
        # Every step but the first, with the one before it.
        after = max(s, 1)
        place = np.arange(first[min(after, e)], first[e])
        left = np.concatenate([heads[k], alpha])[place - np.repeat(alive[after - 1 : e - 1], alive[after:e]) - low + len(heads[k])]
        right = beta[place - low]
        right /= ((left @ model.move) * right).sum(axis=1, keepdims=True)
        move += left.T @ right
    return HiddenMarkov(start, move * model.move, counts)


def _model(counts: HiddenMarkov, prior: np.ndarray) -> HiddenMarkov:
    """Distributions from expected counts, with little mass spread by the symbols' overall shares."""
    start = counts.start + 0.1
    move = counts.move + 0.1
    emit = counts.emit + prior[None] * 50.0 + 1e-6
    return HiddenMarkov(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _sums(tokens: DataFrame, held: Vocabulary, states: int, expect: Callable[[list[np.ndarray]], HiddenMarkov]) -> HiddenMarkov:
    """Expectations of all texts: each task sends one row for each symbol that it has met, and these are summed by symbol."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: HiddenMarkov | None = None
        for _, whole in _sequences(frames):
            for texts in _alike(whole, RUN_TOKENS):
                part = expect(texts)
                total = part if total is None else HiddenMarkov(total.start + part.start, total.move + part.move, total.emit + part.emit)
        if total is not None:
            met = np.flatnonzero(total.emit.sum(axis=0))
            rows = np.concatenate([total.emit[:, met].T, total.start[None], total.move])
            names = np.concatenate([met, -1 - np.arange(1 + states)])
            yield pd.DataFrame({"symbol": names} | {f"s{k}": rows[:, k] for k in range(states)})

    columns = [f"s{k}" for k in range(states)]
    rows = tokens.select("_symbols").mapInPandas(partial, "symbol int, " + ", ".join(f"{c} double" for c in columns))
    found = rows.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    values = found[columns].to_numpy(float)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, held.width))
    for name, row in zip(found["symbol"], values, strict=True):
        if name >= 0:
            emit[:, name] = row
        elif name == -1:
            start = row
        else:
            move[-2 - name] = row
    return HiddenMarkov(start, move, emit)


def _first_guess(states: int, width: int) -> Callable[[list[np.ndarray]], HiddenMarkov]:
    """Each text wholly in one state, chosen by its most frequent symbol: texts of a language share it."""

    def count(texts: list[np.ndarray]) -> HiddenMarkov:
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, width))
        own: dict[int, list[np.ndarray]] = {}
        for t in texts:
            own.setdefault(int(np.bincount(t).argmax()) % states, []).append(t)
        for k, mine in own.items():
            start[k] = len(mine)
            move[k, k] = sum(map(len, mine)) - len(mine)
            emit[k] = np.bincount(np.concatenate(mine), minlength=width)
        return HiddenMarkov(start, move, emit)

    return count


def fit(tokens: DataFrame, held: Vocabulary, states: int = STATES, iterations: int = ITERATIONS) -> HiddenMarkov:
    """Baum-Welch over all whole texts of a ``tokenised`` table. The driver holds states x symbols numbers, whose bound is SYMBOLS + SUFFIXES symbols."""
    counts = _sums(tokens, held, states, _first_guess(states, held.width))
    prior = counts.emit.sum(axis=0)
    prior = prior / max(prior.sum(), 1.0)
    model = _model(counts, prior)
    for _ in range(iterations):
        now = model
        model = _model(_sums(tokens, held, states, lambda texts: expectations(now, texts)), prior)  # noqa: B023
    return model


def score(tokens: DataFrame, held: Vocabulary, model: HiddenMarkov, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's ``keep`` columns with n_tokens, n_known, train_tokens, base_score and score, from a ``tokenised`` table.

    One output row per input row, repeated rows and null ids included; a null text counts as
    empty, which is the end token alone. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the
    tokens, score is the model's log10 probability of the whole text. Other columns take no part.

    Frequent words were counted where the text was read. All other words, some tenth of the tokens, meet their
    counts in a join, which no frequent word can skew; what a text's rare words add is then summed by row.
    """
    rows = tokens.select(*keep, "_row", (F.length("_symbols") / 2).cast("bigint").alias("n_tokens"), "_n", "_base", "_share", "_symbols")
    schema = rows.drop("_symbols").schema.add("_hmm", "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, whole in _sequences(frames):
            frame["_hmm"] = log_likelihood(model, whole)
            yield frame

    spark = tokens.sparkSession
    sent = F.broadcast(spark.createDataFrame([(w,) for w, _ in held.sent], "word string"))
    rare = tokens.where(F.col("_rare") != "").select("_row", F.explode(F.split("_rare", " ")).alias("word"))
    rare_counts = counts.join(sent, "word", "left_anti")
    n = F.coalesce("n", F.lit(0))
    sizes = F.array(*[F.lit(float(x)) for x in held.class_sizes])
    share = F.log10((n + 0.1) / F.get(sizes, suffix_of(F.col("word"))))
    base = F.log10((n + 0.1) / F.lit(held.total + 0.1 * (held.distinct + 1)))
    joined = rare.join(rare_counts, "word", "left").select("_row", (n > 0).cast("bigint").alias("known"), base.alias("base"), share.alias("share"))
    extra = joined.groupBy("_row").agg(F.sum("known").alias("_known"), F.sum("base").alias("_rare_base"), F.sum("share").alias("_rare_share"))
    both = rows.mapInPandas(run, schema).join(extra, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(
        *keep,
        "n_tokens",
        (F.col("_n") + zero("_known")).alias("n_known"),
        F.lit(held.total).cast("bigint").alias("train_tokens"),
        (F.col("_base") + zero("_rare_base")).alias("base_score"),
        (F.col("_hmm") + F.col("_share") + zero("_rare_share")).alias("score"),
    )
