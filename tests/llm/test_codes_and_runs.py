"""Vector codes, byte-level BPE and periodic runs against brute force and against the tokenizers' own library."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from graphloom.llm import bpe, queries, runs, vectorcode

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [(None, None), (1, None), (2, ""), (2, ""), (3, "one"), (3, "one"), (None, "one"), (4, "x " * 30_000), (5, "a b c d e f g h"), (6, "a b\x1cc\x0bd e ÄÖ 漢字 \U0001f600")]
WORDS = "ab cd ef gh it's don't 12 3 ?! É 漢字".split()


def awkward(spark):
    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in AWKWARD], DOCS)
    for name in ("ids", "_text", "runs", "decoded", "_ids", "n_words", "_words"):
        made = made.withColumn(name, F.lit(1))
    return made


def table(spark, tmp_path, name, rows):
    rows.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- byte-level BPE ---


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_is_the_librarys(reference):
    made = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeABC 123'stl\n\té漢\U0001f600.,!-  \x1c") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += [f"a{chr(c)}1 {chr(c)}b  {chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for text in texts:
        ids = np.frombuffer(made.encode(text), "<i4").tolist()
        assert ids == reference.encode_ordinary(text)
        assert made.decode(ids) == text.encode()
    assert made.decode([]) == b"" and made.decode([1, 10**6]) is None


def test_long_texts_are_cut_where_pre_tokens_end(reference, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 7)
    made = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n\t.'s1 ") for _ in range(rng.randint(0, 90)))
        assert "".join(made.slices(text)) == text
        assert np.frombuffer(made.encode(text), "<i4").tolist() == reference.encode_ordinary(text)


def test_bpe_query(spark, tmp_path, reference):
    found = queries.op12_byte_bpe(spark, table(spark, tmp_path, "documents", awkward(spark))).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    wanted = []
    for i, text in AWKWARD:
        ids = reference.encode_ordinary(text or "")
        wanted.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    empty = spark.createDataFrame([], DOCS)
    assert bpe.decode(bpe.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None]), (3, []), (4, [15496])], "doc_id bigint, ids array<int>")
    back = {r.doc_id: r.decoded for r in bpe.decode(odd, RANKS, public_tokenizers.PATTERN).collect()}
    assert {k: v if v is None else bytes(v) for k, v in back.items()} == {1: None, 2: None, 3: b"", 4: b"Hello"}


# --- periodic runs ---


def all_runs(w, min_words=24):
    """Every lag and every place, and every smaller period."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if j > i and length >= max(min_words, 3 * q) and not any(all(w[k] == w[k - p] for k in range(s + p, j)) for p in range(1, q)):
                out.append((s, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng, kinds, most):
    w = []
    while len(w) < most:
        r = rng.random()
        if r < 0.4:
            w += [rng.randrange(kinds) for _ in range(rng.randint(1, 9))] * rng.randint(1, 12)
        elif r < 0.7 and w:
            w += w[rng.randrange(len(w)) :]
        else:
            w += [rng.randrange(kinds) for _ in range(rng.randint(1, 20))]
    return w[: 2 * most]


def test_runs_are_all_runs():
    rng = random.Random(3)
    for _ in range(600):
        texts = [repetitive(rng, rng.choice([1, 2, 3, 5]), rng.randint(0, 130)) for _ in range(rng.randint(1, 3))]
        least = rng.choice([4, 9, 24])
        wanted, off = [], 0
        for w in texts:
            wanted += [(s + off, n, q) for s, n, q in all_runs(w, least)]
            off += len(w)
        flat, doc = np.array([x for w in texts for x in w], np.int64), np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        assert runs.find_runs(flat, doc, max(map(len, texts)) // 3, least) == sorted(wanted, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w) if len(set(w)) > 1 else [(0, len(w), 1)] * (len(w) >= 24)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    top = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_query(spark, tmp_path):
    rng = random.Random(4)
    given = [*AWKWARD, *((i, " ".join(WORDS[k] for k in repetitive(rng, 11, rng.randint(0, 160))) + rng.choice(["", " \n", "\t"])) for i in range(10, 150))]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in given], DOCS)
    found = queries.op13_runs(spark, table(spark, tmp_path, "documents", rows)).collect()
    wanted = [brute_row(i, t) for i, t in given]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in given) > 5 and sum(r[1] > 1 for r in wanted) > 5
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    kept = runs.periodic_runs(awkward(spark), keep=("doc_id", "_text", "_words"))
    assert kept.columns == ["doc_id", "_text", "_words", "n_words", "runs", "collapsed"] and kept.count() == len(AWKWARD)
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


# --- vector codes ---


def plain_codes(rows, entries=256, rounds=4):
    """Every distance of every part to every entry, in whole numbers."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = -(-max(len(v) for _, v, _ in kept) // 4) * 4
    x = np.array([[int(np.floor(1024 * c)) for c in v] + [0] * (width - len(v)) for _, v, _ in kept], object).reshape(len(kept), width)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, list(kept[k][1])))[:entries]
    parts = np.split(x, 4, axis=1)
    books = [p[order].copy() for p in parts]

    def nearest(p, b):
        return np.array([[sum((int(c) - int(d)) ** 2 for c, d in zip(row, e)) for e in b] for row in p], object)

    for _ in range(rounds):
        for p, b in zip(parts, books):
            own = nearest(p, b).argmin(axis=1)
            for e in set(own.tolist()):
                b[e] = [sum(int(r[j]) for r in p[own == e]) // int((own == e).sum()) for j in range(p.shape[1])]
    far = [nearest(p, b) for p, b in zip(parts, books)]
    own = [f.argmin(axis=1) for f in far]
    error = [sum(int(f[k, o[k]]) for f, o in zip(far, own)) for k in range(len(kept))]
    labels = {}
    for (_, _, g), e in zip(kept, error):
        labels[g] = labels.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for row in b for c in row).encode()).hexdigest()
    return [(i, "".join(f"{int(o[k]):02x}" for o in own), error[k], labels[g], digest) for k, (i, _, g) in enumerate(kept)]


SCHEMA = "vec_id bigint, embedding array<float>, label int"
COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def same_codes(spark, rows, schema=SCHEMA, **given):
    found = vectorcode.encode(spark.createDataFrame(rows, schema).repartition(3), **given).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_codes(rows, given.get("entries", 256))))


def vectors(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(7, width)) * scale
    return [(int(i), [float(np.float32(c)) for c in centre[i % 7] + rng.normal(size=width) * 0.05 * scale], int(i % 5) if i % 11 else None) for i in rng.permutation(n)]


def test_codes_are_those_of_plain_rounds(spark):
    same_codes(spark, vectors(420, 8, 1), entries=20)
    same_codes(spark, vectors(300, 8, 2))
    copies = vectors(60, 8, 3)
    same_codes(spark, copies + [(900 + k, copies[0][1], 1) for k in range(200)] + copies[:9], entries=30)


def test_codes_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [None] * 8, 1), (3, [nan] * 8, 1), (4, [inf] + [0.0] * 7, 2), (None, [0.5] * 8, None), (5, [0.0] * 8, None), (5, [0.0] * 8, None), (5, [-0.0003] * 8, 3), (6, [1.0, 2.0, 3.0], 3), (7, [], 3)]
    same_codes(spark, odd)
    same_codes(spark, odd + [(8, [0.25] * 9, 3)], entries=2)
    same_codes(spark, [(1, [1e5, -3e5], 1), (2, [2e5, 7.0], 1), (3, [5.0, 7.0], 2), (4, [2e5, 7.5], 2)], "vec_id bigint, embedding array<double>, label int", entries=2)
    same_codes(spark, [(1, [], 1), (2, [], None)])
    assert vectorcode.encode(spark.createDataFrame(odd[:4], SCHEMA)).count() == 0
    largest = vectorcode.encode(spark.createDataFrame([(1, [1e300], 1), (2, [-1e300], 1)], "vec_id bigint, embedding array<double>, label int"), entries=1).collect()
    assert len(largest) == 2 and all(r.error == r.label_error == 2**63 - 1 for r in largest)


def test_label_errors_beyond_the_labels_that_are_sent(spark, monkeypatch):
    monkeypatch.setattr(vectorcode, "SENT_LABELS", 2)
    same_codes(spark, vectors(90, 4, 5), entries=4)


def test_codes_query(spark, tmp_path):
    rows = spark.createDataFrame(vectors(300, 8, 6), SCHEMA).withColumn("code", F.lit(1)).withColumn("v", F.lit(2)).withColumn("_n", F.lit(3))
    found = queries.op11_vector_codes(spark, table(spark, tmp_path, "embeddings", rows)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_codes(vectors(300, 8, 6))))


def test_balls_are_wholly_owned():
    """Well separated groups: the rounds need the cached sums only."""
    rng = np.random.default_rng(7)
    centre = rng.integers(-9000, 9000, (12, 4))
    x = (centre[rng.integers(0, 12, 2000)] + rng.integers(-3, 4, (2000, 4))).astype(np.int32)
    tree = vectorcode.build_tree(x)
    owner, balls, looked = vectorcode.assign(tree, x, centre)
    assert balls and sum(map(len, looked)) < 100
    assert (owner == ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    sums, counts = vectorcode.round_sums(tree, x, centre)
    assert (counts == np.bincount(owner, minlength=12)).all() and sums.sum() == x.sum()


# --- what earlier operators got wrong ---


@pytest.mark.parametrize("pad", range(0, 200, 7))
def test_spans_are_not_cut_at_windows(pad):
    from graphloom.llm import pii

    local = "q" * 150
    text = "x" * pad + " " + local + "@" + "q" * 40 + ".qq " + "x" * 100
    assert pii.model_spans(Ideal(), [text]) == [[("email", pad + 1, pad + 195)]]


class Ideal:
    """Tags the letter q, the sign of an address and dots as an address, wherever a window shows them."""

    def decode(self, x):
        from graphloom.llm import pii

        rows = np.ascontiguousarray(x.T)
        out = np.zeros_like(rows)
        for k, row in enumerate(rows):
            inside = np.isin(row, [pii.classes(c)[0] for c in "q@."])
            out[k][inside] = 2
            first = np.flatnonzero(inside)
            if len(first) and first[0]:
                out[k][first[0]] = 1
        return out.T


def test_repeated_vectors_are_searched(spark, tmp_path):
    rows = spark.range(3000).select(F.lit(40).cast("bigint").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    rows = rows.unionByName(spark.createDataFrame([(7, [2.0, 1.0], 1)], "vec_id bigint, embedding array<float>, label int"))
    from graphloom.llm import ann
    from graphloom.llm.common import first_by_hash

    for n in (3, 10):
        assert first_by_hash(ann.valid_vectors(rows, "vec_id", "embedding"), n, "vec_id", "v").count() == n
    found = queries.op8_ann(spark, table(spark, tmp_path, "embeddings", rows)).collect()
    assert {(r.query_id, r.vec_id, round(r.score, 6)) for r in found} >= {(40, 7, 4.0)}


def test_callers_columns_survive(spark):
    from graphloom.llm.decontaminate import decontaminate
    from graphloom.llm.neardup import deduplicate

    made = spark.createDataFrame([(1, "some words of a text that is no item at all", "en", "s", 3)], DOCS)
    for name in ("_digest", "_text_key", "_id", "_h", "k", "node"):
        made = made.withColumn(name, F.lit(name))
    items = spark.createDataFrame([(1, "an item of the benchmark with enough words to be found")], "item_id bigint, text string")
    for out in (decontaminate(made, items), deduplicate(made)):
        assert out.columns == made.columns
        assert [r.asDict() for r in out.collect()] == [r.asDict() for r in made.collect()]
