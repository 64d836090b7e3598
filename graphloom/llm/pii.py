"""Personal data by patterns and by a character-level bidirectional LSTM with CRF transitions.

The patterns (email, ip, card, phone) find the base spans. The network, trained in numpy on
labelled spans, reads overlapping windows of characters; each window is decoded by the CRF, and
the decodings are reconciled over the whole text: every character takes its tag
from the window in which it lies deepest. Among the labelled spans are base ones in other writing
(other separators, no plus sign, dots and at signs in words), which the patterns do not match
and the network so learns to find. Model spans are added to the base ones where they touch none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import blocks, first_by_hash, kept, written

KINDS = ("email", "ip", "card", "phone")
WINDOW, STEP = 96, 64
#: Tags: 0 outside, then for each kind its first and its further characters.
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 24
EMBED = 12
#: A model span is taken only if its digits lie in this range; windows without a digit or a sign of an address are outside.
DIGITS = {"email": (0, 1 << 30), "ip": (4, 12), "card": (13, 19), "phone": (9, 15)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)+")
_NUMBER = re.compile(r"[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"@|[\[(] ?at ?[\])]", re.IGNORECASE)
_TRIGGER = re.compile(rf"[0-9]|{_AT.pattern}", re.IGNORECASE)

# The characters that the network tells apart; others share a class by kind.
ALPHABET = "0123456789@.-+() _%:/,;|#*"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All pattern spans (kind, start, end), by kind as listed and then by start. Linear in the text."""
    out: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for chain in _DOTTED.finditer(text):
        parts = list(_NUMBER.finditer(text, chain.start(), chain.end()))
        # A match takes four parts, and the next one starts after it.
        for k in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                out.append(("ip", parts[k].start(), parts[k + 3].end()))
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_CLASS: np.ndarray | None = None
CLASSES = len(ALPHABET) + 6


def classes(text: str) -> np.ndarray:
    """The network's input: a class for each code point (0 is padding)."""
    global _CLASS
    if _CLASS is None:
        table = np.full(0x3000, 5, np.uint8)
        for c in range(0x3000):
            if chr(c).islower():
                table[c] = 1
            elif chr(c).isupper():
                table[c] = 2
            elif chr(c).isspace():
                table[c] = 3
            elif chr(c).isalnum():
                table[c] = 4
        for k, c in enumerate(ALPHABET):
            table[ord(c)] = 6 + k
        _CLASS = table
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(code, 0x2FFF)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Parameters by name; both directions share the layout (input, recurrent, bias), gates in the order i, f, o, g."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"embed": draw(CLASSES, EMBED) * 2, "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0
            p |= {f"w{d}": draw(EMBED, 4 * HIDDEN), f"u{d}": draw(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
        return Tagger(p)

    def _direction(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states (time, batch, hidden) of one direction, and what the backward pass needs."""
        p, n = self.p, x.shape[1]
        table = p["embed"] @ p[f"w{d}"] + p[f"b{d}"]
        h, c = np.zeros((n, HIDDEN), table.dtype), np.zeros((n, HIDDEN), table.dtype)
        out, held = np.empty((len(x), n, HIDDEN), table.dtype), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = table[x[t]] + h @ p[f"u{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                held.append((t, i, f, o, g, tc, before))
        return out, held

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, batch, tag) of windows (time, batch)."""
        hidden = np.concatenate([self._direction(x, d, False)[0] for d in "fb"], axis=2)
        return hidden @ self.p["out"] + self.p["out_b"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (time, batch) by Viterbi."""
        e = self.emissions(x)
        best = e[0] + self.p["start"]
        back = np.empty(e.shape, np.uint8)
        for t in range(1, len(e)):
            step = best[:, :, None] + self.p["move"]
            back[t] = step.argmax(axis=1)
            best = step.max(axis=1) + e[t]
        tags = np.empty(x.shape, np.uint8)
        tags[-1] = best.argmax(axis=1)
        rows = np.arange(x.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        return tags

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y (time, batch) and its gradient."""
        p, (steps, n) = self.p, x.shape
        held = {d: self._direction(x, d, True) for d in "fb"}
        hidden = np.concatenate([held[d][0] for d in "fb"], axis=2)
        e = (hidden @ p["out"] + p["out_b"]).astype(np.float64)
        move, rows = p["move"].astype(np.float64), np.arange(n)
        # Scaled forward and backward sums: ``a`` adds up to 1 at each time, and so does ``a`` times ``b``.
        peak, most = e.max(axis=2), move.max()
        likely, step = np.exp(e - peak[:, :, None]), np.exp(move - most)
        a, b, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, n))
        for t in range(steps):
            a[t] = likely[t] * (a[t - 1] @ step if t else np.exp(p["start"].astype(np.float64)))
            scale[t] = a[t].sum(axis=1)
            a[t] /= scale[t][:, None]
        ahead = likely / scale[:, :, None]
        for t in range(steps - 1, 0, -1):
            ahead[t] *= b[t]
            b[t - 1] = ahead[t] @ step.T
        whole = (np.log(scale) + peak).sum(axis=0) + (steps - 1) * most
        gold = e[np.arange(steps)[:, None], rows, y].sum(axis=0) + p["start"][y[0]] + move[y[:-1], y[1:]].sum(axis=0)
        pairs = np.bincount((y[:-1].astype(np.int64) * TAGS + y[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        g = {"move": a[:-1].reshape(-1, TAGS).T @ ahead[1:].reshape(-1, TAGS) * step - pairs}
        ge = a * b
        ge[np.arange(steps)[:, None], rows, y] -= 1.0
        g["start"], g["out_b"] = ge[0].sum(axis=0), ge.sum(axis=(0, 1))
        g["out"] = hidden.reshape(-1, 2 * HIDDEN).T @ ge.reshape(-1, TAGS)
        gh = ge.astype(hidden.dtype) @ p["out"].T
        of_class = (x.ravel() == np.arange(CLASSES)[:, None]).astype(hidden.dtype)
        g["embed"] = np.zeros(p["embed"].shape)
        for k, d in enumerate("fb"):
            out, kept_steps = held[d]
            gz = np.empty((steps, n, 4 * HIDDEN), out.dtype)
            carry_h = carry_c = np.zeros((n, HIDDEN), out.dtype)
            back = np.ascontiguousarray(p[f"u{d}"].T)
            for t, i, f, o, c_in, tc, c in reversed(kept_steps):
                dh = gh[t][:, k * HIDDEN : (k + 1) * HIDDEN] + carry_h
                dc = dh * o * (1 - tc * tc) + carry_c
                gz[t] = np.concatenate([dc * c_in * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c_in * c_in)], axis=1)
                carry_h, carry_c = gz[t] @ back, dc * f
            before = np.zeros_like(out)
            if d == "f":
                before[1:] = out[:-1]
            else:
                before[:-1] = out[1:]
            flat = gz.reshape(-1, 4 * HIDDEN)
            g[f"u{d}"], g[f"b{d}"] = before.reshape(-1, HIDDEN).T @ flat, flat.sum(axis=0)
            by_class = of_class @ flat
            g[f"w{d}"] = p["embed"].T @ by_class
            g["embed"] += by_class @ p[f"w{d}"].T
        return float((whole - gold).mean()), {k: v / n for k, v in g.items()}


def windows_of(text: str, spans: list[tuple[str, int, int]] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, classes, tags) of the windows of a whole text that hold a digit, the sign of an address or a part of a span; short texts are padded."""
    x = classes(text)
    y = np.zeros(len(x), np.uint8)
    wanted = {k for m in _TRIGGER.finditer(text) for k in _windows_at(m.start(), m.start() + 1)}
    for kind, a, b in spans or ():
        k = 1 + 2 * KINDS.index(kind)
        y[a], y[a + 1 : b] = k, k + 1
        wanted.update(_windows_at(a, b))
    for k in sorted(wanted):
        yield k * STEP, _window(x, k), _window(y, k)


def _windows_at(a: int, b: int) -> range:
    """The numbers of the windows that hold any of the characters from a to b."""
    return range(max(0, (a - WINDOW) // STEP + 1), (b - 1) // STEP + 1)


def _window(x: np.ndarray, k: int) -> np.ndarray:
    a = k * STEP
    return np.pad(x[a : a + WINDOW], (0, max(0, a + WINDOW - len(x))))


def train(x: np.ndarray, y: np.ndarray, steps: int = 260, batch: int = 48, rate: float = 0.01, seed: int = 11) -> Tagger:
    """A tagger fitted to labelled windows (rows of x and y) by about ``steps`` steps of Adam."""
    model = Tagger.new(seed)
    rng = np.random.default_rng(seed)
    first, second, step = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    epochs = max(1, round(steps / -(-len(x) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            _, g = model.gradient(np.ascontiguousarray(x[own].T), np.ascontiguousarray(y[own].T))
            norm = np.sqrt(sum((v**2).sum() for v in g.values()))
            step += 1
            pace = rate * (1 - epoch / epochs)
            for name, value in g.items():
                value = value * min(1.0, 5.0 / max(norm, 1e-12))
                first[name] = 0.9 * first[name] + 0.1 * value
                second[name] = 0.999 * second[name] + 0.001 * value**2
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                model.p[name] = (model.p[name] - pace * move).astype(np.float32)
    return model


def disguised(text: str, spans: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its spans in other writing, which the patterns mostly do not match, and these spans; overlapping ones are left out."""
    pick = lambda *choices: choices[rng.integers(len(choices))]
    out, made, at, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a < at:
            continue
        piece = text[a:b]
        numbers = _NUMBER.findall(piece)
        if kind == "email":
            local, _, domain = piece.partition("@")
            piece = local + pick(" [at] ", "[at]", "(at)", " (at) ", " @ ") + domain.replace(".", pick(".", " . ", "[.]", " [dot] "))
        elif kind == "ip":
            piece = pick(" . ", "[.]", ". ", "(.)").join(numbers)
        elif kind == "card":
            digits = "".join(numbers)
            piece = pick(".", "/", "_", "  ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
        else:
            piece = pick("", "00", "tel:") + pick(" ", "-", ".", "/").join(numbers)
        out += [text[at:a], piece]
        size += a - at
        made.append((kind, size, size + len(piece)))
        size += len(piece)
        at = b
    return "".join(out) + text[at:], made


def fit(docs: DataFrame, text: str = "text", per_kind: int = 120, max_chars: int = 20_000, steps: int = 400) -> Tagger | None:
    """A tagger of a bounded sample of labelled spans: for each kind the ``per_kind`` texts first in hash order.

    Labels are the base spans, as they are and in other writing (``disguised``). Texts of more than ``max_chars`` characters are not learned from. Also learned are
    as many texts with digits but without spans. None if there is no span to learn from.
    """

    def kinds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, h) for h, t in zip(frame["h"], frame["t"], strict=True) for k in {k for k, _, _ in base_spans(t)} or {"none"}]
            yield pd.DataFrame(out, columns=["kind", "h"])

    rows = docs.select(F.col(text).alias("t")).where(F.length("t") <= max_chars).where(F.col("t").rlike("[0-9@]")).withColumn("h", F.xxhash64("t"))
    # Hashes are chosen first; the few texts are fetched by them.
    found = written(rows.mapInPandas(kinds, "kind string, h bigint").distinct(), "kinds")
    chosen: set[int] = set()
    spanned = False
    for kind in (*KINDS, "none"):
        own = [r["h"] for r in first_by_hash(found.where(F.col("kind") == kind), per_kind, "h").collect()]
        chosen.update(own)
        spanned |= bool(own) and kind != "none"
    if not spanned:
        return None
    keys = docs.sparkSession.createDataFrame([(h,) for h in sorted(chosen)], "h bigint")
    texts = {r["t"] for r in rows.join(F.broadcast(keys), "h").select("t").distinct().collect()}
    rng = np.random.default_rng(3)
    labelled = [(t, base_spans(t)) for t in sorted(texts)]
    labelled += [disguised(t, spans, rng) for t, spans in labelled if spans]
    xs, ys = zip(*[(x, y) for t, spans in labelled for _, x, y in windows_of(t, spans)], strict=True)
    x, y = np.stack(xs), np.stack(ys)
    # Windows with spans, and as many without.
    with_span = np.flatnonzero(y.any(axis=1))
    without = rng.permutation(np.flatnonzero(~y.any(axis=1)))[: len(with_span)]
    own = rng.permutation(np.concatenate([with_span, without]))[: 16 * per_kind]
    return train(x[own], y[own], steps)


def _plausible(kind: str, piece: str) -> bool:
    """Whether a model span could be of its kind, however it is written: a card number must pass Luhn, an address have four numbers up to 255, and a phone number a plus sign or parts."""
    numbers = _NUMBER.findall(piece)
    digits = "".join(numbers)
    low, high = DIGITS[kind]
    fine = {
        "email": lambda: bool((m := _AT.search(piece)) and re.search(r"[A-Za-z0-9]", piece[: m.start()]) and re.search(r"[A-Za-z0-9].*(\.|dot).*[A-Za-z0-9]", piece[m.end() :])),
        "ip": lambda: len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers),
        "card": lambda: luhn(digits),
        "phone": lambda: "+" in piece or len(numbers) > 2,
    }[kind]
    return low <= len(digits) <= high and fine()


def text_digit(text: str, at: int) -> bool:
    return text[at] in "0123456789"


def model_spans(model: Tagger, texts: list[str], batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """The network's spans of whole texts, reconciled over their windows.

    Each character takes the tag of the window where it lies deepest, which is the one whose middle part (its first part too, at the
    text's start) it is in; so windows neither vie nor depend on their order. Windows with a digit or the sign of an address are decoded, and then, on
    both sides, those that a span goes on into, as far as it goes: a span without any such character can be of no kind.
    """
    read = [classes(t) for t in texts]
    tags: dict[int, np.ndarray] = {}
    edge = (WINDOW - STEP) // 2
    todo = [(k, w) for k, t in enumerate(texts) for w in sorted({w for m in _TRIGGER.finditer(t) for w in _windows_at(m.start(), m.start() + 1)})]
    seen = set(todo)
    while todo:
        more = []
        for first in range(0, len(todo), batch):
            part = todo[first : first + batch]
            decoded = model.decode(np.ascontiguousarray(np.stack([_window(read[k], w) for k, w in part]).T)).T
            for (k, w), y in zip(part, decoded, strict=True):
                a = w * STEP
                low, high = (edge if a else 0), min(edge + STEP, len(texts[k]) - a)
                if low >= high or not y[low:high].any():
                    continue
                if k not in tags:
                    tags[k] = np.zeros(len(texts[k]), np.uint8)
                tags[k][a + low : a + high] = y[low:high]
                if y[low] and a:
                    more.append((k, w - 1))
                if y[high - 1] and a + high < len(texts[k]):
                    more.append((k, w + 1))
        todo = sorted({*more} - seen)
        seen.update(todo)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k, y in tags.items():
        kind = (y.astype(np.int64) + 1) // 2
        cut = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | ((y[1:] % 2 == 1) & (y[1:] > 0))]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(y)], strict=True):
            if kind[a]:
                name, piece = KINDS[kind[a] - 1], texts[k][a:b]
                core = piece.strip(" .,;:|")
                a += piece.find(core) if core else 0
                b = a + len(core)
                # A number is never cut: the span takes in the digits it touches.
                while core and 0 < a and text_digit(texts[k], a) and text_digit(texts[k], a - 1):
                    a -= 1
                while core and b < len(y) and text_digit(texts[k], b) and text_digit(texts[k], b - 1):
                    b += 1
                if core and _plausible(name, texts[k][a:b]):
                    out[k].append((name, a, b))
    return out


def all_spans(base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans and those of the model that overlap none of them, nor an earlier one of the model."""
    if not found:
        return base
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out, last = list(base), 0
    for s in sorted(found, key=lambda s: (s[1], s[2])):
        before = bisect_left(starts, s[2])  # base spans that start before it ends
        if s[1] >= last and (not before or reach[before - 1] <= s[1]):
            out.append(s)
            last = s[2]
    return out


def find_pii(docs: DataFrame, model: Tagger | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: bool = False) -> DataFrame:
    """Each row's ``keep`` columns with n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_spans; with ``redact`` also redacted.

    The counts and the digest are of the base spans, spans holds all, offsets are code points.
    One output row per input row, repeated rows and null ids included; a null text counts as empty and has no
    spans. Whole texts are read: the patterns see every character, and the network every window with a digit or the sign of an
    address and all that a span reaches from there. Without a model there are base spans only. redacted is the text with every span
    replaced by its kind in brackets (overlapping base spans by the first one's); other columns take no part.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep).schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long").add("n_spans", "long")
    if redact:
        schema = schema.add("redacted", "string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept("personal data")
        for frame in blocks(frames, "_text", 1_000_000):
            texts = list(frame["_text"])
            base = [base_spans(t) for t in texts]
            found = model_spans(model, texts) if model else [[] for _ in texts]
            spans = [all_spans(b, f) for b, f in zip(base, found, strict=True)]
            frame = frame.drop(columns=["_text"])
            for k in KINDS:
                frame[f"n_{k}"] = [sum(s[0] == k for s in b) for b in base]
            frame["base_sha256"] = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
            frame["spans"] = [joined(s) for s in spans]
            frame["n_added"] = [len(s) - len(b) for s, b in zip(spans, base, strict=True)]
            frame["n_spans"] = [len(s) for s in spans]
            if redact:
                frame["redacted"] = [_redacted(t, s) for t, s in zip(texts, spans, strict=True)]
            yield frame

    return rows.mapInPandas(run, schema)


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text
