"""The training-data operators on small fixtures: brute force, round trips, and awkward rows."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import ann, decontaminate, hmm, langid, neardup, packing, pii, quality, queries, sharding, warc
from graphloom.llm.common import WORD, scratch

RNG = np.random.default_rng(5)
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, stem=""):
    rng = np.random.default_rng(seed)
    return " ".join(stem + "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 7))) for _ in range(n))


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in texts], DOCS)


AWKWARD = [(None, None), (1, None), (2, ""), (2, ""), (3, "one"), (3, "one"), (None, "one"), (4, "x " * 30_000), (5, "a b c d e f g h")]


def awkward(spark):
    """Nulls, empty, repeated and very long rows, and columns whose names could clash with an operator's own."""
    made = docs(spark, AWKWARD)
    for name in ("node", "bands", "score", "rank", "_text", "_read", "bucket", "label", "kept", "n"):
        made = made.withColumn(name, F.lit(1))
    return made


# --- near duplicates ---


def shingle_counts(text):
    w = WORD.findall(text.lower())
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def exact_similarity(a, b):
    x, y = shingle_counts(a), shingle_counts(b)
    both = x.keys() & y.keys()
    if not both:
        return 0.0
    u, v = ({s: 1 + np.log(n) for s, n in c.items()} for c in (x, y))
    keys = x.keys() | y.keys()
    weighted = sum(1 / sum(max(u.get(k, 0) / u[s], v.get(k, 0) / v[s]) for k in keys) for s in both)
    return max(len(both) / len(keys), weighted)


def brute_classes(rows, threshold=0.8):
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or exact_similarity(rows[i][1], rows[j][1]) >= threshold - 1e-9:
                parent[root(i)] = root(j)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def edited(text, edits, seed):
    rng = np.random.default_rng(seed)
    w = text.split(" ")
    for k in rng.choice(len(w), edits, replace=False):
        w[k] = "zz" + str(k) + str(seed)
    return " ".join(w)


def test_near_duplicates_match_brute_force(spark):
    rows, n = [], 0
    for g in range(6):
        base = words(120, g)
        for k, edits in enumerate((0, 0, 1, 2, 4, 9)):
            rows.append((n, edited(base, edits, 100 * g + k)))
            n += 1
    base = words(60, 99)
    rows += [(n + k, edited(base, 1, 1000 + k)) for k in range(40)]  # a bucket too large for all pairs
    line = words(12, 77)
    rows += [(200 + k, words(20, 300 + k) + " " + " ".join([line] * (k % 3 + 1))) for k in range(6)]
    found = neardup.near_duplicates(docs(spark, rows)).toPandas()
    assert dict(zip(found.doc_id, found.class_id, strict=True)) == brute_classes(rows)
    assert found.kept.sum() == found.class_id.nunique()
    kept = {r.doc_id for r in neardup.deduplicate(docs(spark, rows)).collect()}
    assert kept == set(found.doc_id[found.kept])


def drifting(n, width=100, edits=3, seed=5):
    """Texts of which each is the one before with a few words changed: neighbours are alike, far ones are not."""
    out = [words(width, seed)]
    for k in range(1, n):
        out.append(edited(out[-1], edits, 5000 + k))
    return out


@pytest.mark.parametrize(("compared", "texts"), [(8192, 512), (8192, 7), (20, 7)])
def test_large_groups_match_brute_force(spark, monkeypatch, compared, texts):
    monkeypatch.setattr(neardup, "COMPARED", compared)
    monkeypatch.setattr(neardup, "CHUNK_TEXTS", texts)
    rows = list(enumerate(drifting(40)))
    base, part = words(90, 31).split(" "), words(14, 32)
    # Two tight clusters that one pair of texts bridges, and texts that differ in how often a part repeats.
    for side in (0, 1):
        for k in range(20):
            w = list(base)
            for e in range(7):
                w[(40 * side + 6 * e) % 90] = f"s{side}e{e}"
            w[80 + k % 9] = f"own{side}x{k}"
            rows.append((100 + 50 * side + k, " ".join(w)))
    rows += [(300 + k, words(30, 33) + " " + " ".join([part] * (1 + 3 * k)) + f" end{k}") for k in range(24)]
    found = neardup.near_duplicates(docs(spark, rows)).toPandas()
    assert dict(zip(found.doc_id, found.class_id, strict=True)) == brute_classes(rows)


def test_links_join_what_brute_force_joins():
    texts = drifting(30) + [words(20, 3) + " " + " ".join([words(9, 4)] * k) for k in range(1, 8)]
    sets = [np.unique(neardup.shingles(neardup.word_hashes(t), 5), return_counts=True) for t in texts]
    rows = list(enumerate(texts))
    for labels in (np.arange(len(texts)), np.arange(len(texts)) // 3):
        ids = np.arange(len(texts))
        for own, theirs in ((ids, None), (ids[::2], ids[1::2])):
            found = neardup.links(sets, labels, own, own if theirs is None else theirs, 0.8)
            pairs = [(a, b) for a in own for b in (own if theirs is None else theirs) if a != b and exact_similarity(rows[a][1], rows[b][1]) >= 0.8 - 1e-9]
            assert all((a, b) in pairs and labels[a] != labels[b] for a, b in found) and len(found) < len(set(labels))

            def classes(links, labels=labels):
                label = labels.copy()
                for a, b in links:
                    label[label == label[b]] = label[a]
                return {frozenset(np.flatnonzero(label == x).tolist()) for x in set(label)}

            assert classes(found) == classes(pairs)


def test_similarity_equals_its_definition():
    for seed in range(8):
        a = words(40, seed) + " " + " ".join([words(8, 50)] * (seed % 4))
        b = edited(a, 3, seed) + " " + words(8, 50)
        sets = [np.unique(neardup.shingles(neardup.word_hashes(t), 5), return_counts=True) for t in (a, b)]
        assert neardup.similarity(*sets[0], *sets[1]) == pytest.approx(exact_similarity(a, b))


def test_registers_estimate_probability_jaccard():
    a = np.arange(1, 401, dtype=np.uint64) * np.uint64(2654435761)
    wa, wb = 1 + np.arange(400) % 5.0, 1 + np.arange(400) % 3.0
    signs = neardup.signatures([a, a], [wa, wb], 4096)
    agree = (signs[0] == signs[1]).mean()
    total = [(np.maximum(wa / wa[k], wb / wb[k])).sum() for k in range(400)]
    assert agree == pytest.approx(sum(1 / t for t in total), abs=0.03)


def test_near_duplicates_awkward_rows(spark):
    found = neardup.near_duplicates(awkward(spark)).toPandas()
    assert len(found) == len(AWKWARD)
    by_key = found.groupby("text_key")
    assert by_key.class_id.nunique(dropna=False).max() == 1
    kept = neardup.deduplicate(awkward(spark))
    assert kept.count() == 4  # empty, one, the long text and the eight words
    assert neardup.near_duplicates(awkward(spark).limit(0)).count() == 0


# --- decontamination ---


def brute_contained(rows, items, threshold=0.8):
    out = set()
    for i, item in items:
        w = WORD.findall((item or "").lower())
        k = min(5, len(w))
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, text in rows:
            v = WORD.findall((text or "").lower())
            theirs = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
            if own and len(own & theirs) >= threshold * len(own):
                out.add((d, i))
    return out


def test_contamination_matches_brute_force(spark):
    items = [(k, words(8 + 7 * k, 500 + k)) for k in range(9)] + [(20, "two words"), (21, None), (22, ""), (23, "!!!")]
    rows = []
    for k in range(60):
        text = words(40 + 60 * (k % 7), 900 + k).split(" ")
        item = (items[k % 9][1]).split(" ")
        at = int(RNG.integers(0, len(text)))
        part = item if k % 3 == 0 else item[: int(len(item) * (0.9 if k % 3 == 1 else 0.5))]
        rows.append((k, " ".join(text[:at] + part + text[at:])))
    rows += [(100, words(20_000, 1) + " " + items[3][1] + " " + words(3000, 2)), (101, "here are Two, words!"), (102, None), (103, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert found == brute_contained(rows, items)
    clean = {r.doc_id for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in found}


def test_contamination_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "one"), (1, "one"), (None, "a b c d e")], "item_id bigint, text string")
    found = decontaminate.contaminated(awkward(spark), bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == {(3, 1): 4, (None, 1): 2, (5, None): 1}
    assert decontaminate.contaminated(awkward(spark), bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(awkward(spark).limit(0), bench).count() == 0


def test_short_items_in_long_documents_are_found(spark):
    items = [(100 * n + k, words(n, 7000 + 100 * n + k)) for n in (5, 6, 7, 9, 14, 20) for k in range(60)]
    rows = [(i, words(400, 20_000 + i) + " " + text + " " + words(300, 30_000 + i)) for i, text in items]
    nine = dict(items)[900].split()
    rows += [(1, " ".join(nine[:8])), (2, " ".join(nine[:7]))]  # four and three of its five shingles
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = {(i, i) for i, _ in items}
    for threshold, more in ((0.8, {(1, 900)}), (0.6, {(1, 900), (2, 900)})):
        found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, rows), table, threshold=threshold).collect()}
        assert found == whole | more


# --- quality ---


def test_quality_on_held_out_text(spark):
    good = [(k, words(150, k)) for k in range(60)]
    bad = [(100 + k, " | ".join(words(90, k + 7, "QQ").upper().split(" "))) for k in range(60)]
    rows = docs(spark, good + bad + [(500, None), (501, "")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in bad[:40]] + [(None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit_quality(rows, labels)
    score = {r.doc_id: r.score for r in quality.score_quality(rows, model).collect()}
    assert min(score[i] for i, _ in good[40:]) > 0.5 > max(score[i] for i, _ in bad[40:])
    assert score[500] == score[501] and 0 <= score[500] <= 1
    assert quality.score_quality(awkward(spark), model).count() == len(AWKWARD)
    none = quality.fit_quality(rows, labels.limit(0))
    assert {r.score for r in quality.score_quality(rows, none).collect()} == {0.5}


# --- personal data ---

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(1)
    for k in range(6000):
        letters = list("0123456789. -") if k % 3 == 0 else list("a.@-+01259 ()%x3é")
        text = "".join(rng.choice(letters, rng.integers(0, 50)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 50_000 + "a" * 50_000 + "@") == []


def test_tagger_gradient():
    rng = np.random.default_rng(0)
    model = pii.Tagger.new()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(0, pii.CLASSES, (6, 3)), rng.integers(0, pii.TAGS, (6, 3))
    _, grad = model.gradient(x, y)
    for name in ("wf", "ub", "bf", "move", "start", "out"):
        at = tuple(rng.integers(0, s) for s in model.p[name].shape)
        old, e = model.p[name][at], 1e-3
        model.p[name][at] = old + e
        up, _ = model.gradient(x, y)
        model.p[name][at] = old - e
        down, _ = model.gradient(x, y)
        model.p[name][at] = old
        assert (up - down) / (2 * e) == pytest.approx(grad[name][at], abs=2e-4)


def test_tagger_learns_and_redacts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(120):
        text = words(30, k).split(" ")
        things = (f"{words(1, k)}@mail{k}.example.com", ".".join(map(str, rng.integers(1, 255, 4))), f"+1 ({k % 900 + 100}) 555-{1000 + k}", str(int(rng.integers(100, 99_999))))
        text.insert(10, things[k % 4])
        rows.append((k, " ".join(text)))
    table = docs(spark, rows + [(900, None), (901, ""), (902, "9" * 3000 + " " + "b@" * 2000)])
    model = pii.fit(table.where("doc_id < 80"), steps=160)
    hit = total = 0
    held = [t for i, t in rows if i >= 80]
    for text, spans in zip(held, pii.model_spans(model, held), strict=True):
        base = pii.base_spans(text)
        hit += sum(s in spans for s in base)
        total += len(base)
    assert hit / total > 0.8
    found = {r.doc_id: r for r in pii.find_pii(table, model, redact=True).collect()}
    for i, text in rows:
        assert found[i].base_sha256 == hashlib.sha256(pii.joined(plain_spans(text)).encode()).hexdigest()
        assert found[i].n_email == sum(k == "email" for k, _, _ in plain_spans(text))
        assert all(s in found[i].spans for s in [pii.joined([x]) for x in plain_spans(text)])
        assert not plain_spans(found[i].redacted)
    assert found[900].spans == "" and found[900].redacted == ""
    assert pii.find_pii(awkward(spark), None).count() == len(AWKWARD)
    assert pii.fit(awkward(spark)) is None


def test_other_writing_is_found_and_clean_text_left_alone(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(400):
        text = words(30, k).split(" ")
        digits = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        card = next(digits + d for d in "0123456789" if pii.luhn(digits + d))
        text.insert(int(rng.integers(0, 30)), (f"{words(1, k)}@mail{k}.example.com", ".".join(map(str, rng.integers(1, 255, 4))), f"+1 ({k % 900 + 100}) 555-{1000 + k}", card, str(int(rng.integers(100, 99_999))))[k % 5])
        rows.append((k, " ".join(text)))
    model = pii.fit(docs(spark, rows[:300]))
    held = [pii.disguised(t, pii.base_spans(t), rng) for _, t in rows[300:]]
    table = docs(spark, [(k, t) for k, (t, _) in enumerate(held)])
    found = {r.doc_id: r for r in pii.find_pii(table, model).collect()}
    hit = total = wrong = 0
    for k, (text, spans) in enumerate(held):
        got = set(found[k].spans.split(",")) - {""}
        assert {pii.joined([s]) for s in plain_spans(text)} <= got and found[k].n_spans == len(got)
        hit += sum(pii.joined([s]) in got for s in spans)
        total += len(spans)
        wrong += bool(got) and not spans
    assert hit / total > 0.7 and wrong <= 1 and sum(r.n_added for r in found.values()) > 0


def test_windows_are_reconciled_whatever_comes_first():
    class Digits:
        """Tags digits as a phone number where the window holds a plus sign, and as a card otherwise."""

        def decode(self, x):
            number, plus = (x >= 6) & (x <= 15), (x == 6 + pii.ALPHABET.index("+")).any(axis=0)
            return np.where(number, np.where(plus, 8, 6), 0).astype(np.uint8)

    base = "a" * 30 + "+" + "b" * 40 + "12 34 56 78 90 12 34" + "c" * 70 + "1234 5678 9012 34" + "d" * 9

    def brute(text):
        tags = []
        for p in range(len(text)):
            starts = [a for a in range(0, p + 1, pii.STEP) if p < a + pii.WINDOW]
            a = max(starts, key=lambda a: 10**6 if a == 0 and p < pii.WINDOW // 2 else min(p - a, a + pii.WINDOW - 1 - p))
            own = text[a : a + pii.WINDOW]
            tags.append(0 if not text[p].isdigit() else 8 if "+" in own else 6)
        return tags

    held = {}
    plausible, pii._plausible = pii._plausible, lambda kind, piece: True
    try:
        for lead in ("", "x" * 64, "7" + "x" * 127, "+7" + "x" * 126):
            text = lead + base
            (found,) = pii.model_spans(Digits(), [text])
            tags = brute(text)
            for kind, a, b in found:
                assert {t for t, c in zip(tags[a:b], text[a:b], strict=True) if c.isdigit()} == {1 + 2 * pii.KINDS.index(kind) + 1}
            held[lead] = [(k, a - len(lead), b - len(lead)) for k, a, b in found if a >= 128 + 16]
    finally:
        pii._plausible = plausible
    assert held["7" + "x" * 127] == held["+7" + "x" * 126]


def test_spans_are_added_without_overlap():
    base = [("ip", 10, 20), ("card", 15, 40)]
    found = [("card", 0, 10), ("card", 5, 12), ("phone", 39, 50), ("phone", 40, 50), ("email", 45, 60)]
    assert pii.all_spans(base, found) == [*base, ("card", 0, 10), ("phone", 40, 50)]


# --- shards ---


def test_shards_round_trip_and_versions(spark):
    store = sharding.ShardStore(spark, scratch(spark, "t"), target_bytes=1 << 20, fanout=3)
    table = docs(spark, [(k, words(30, k)) for k in range(300)] + AWKWARD).withColumn("arrival", F.coalesce(F.col("doc_id") % 5, F.lit(0)))
    made = store.append(table, rows_per_shard=20, by="arrival")
    assert [m.version for m in made] == [1, 2, 3, 4, 5]
    before = store.read()
    last = store.compact()
    assert last.version > 5 and len(last.shards) < len(made[-1].shards)
    want = Counter(map(tuple, table.drop("arrival").collect()))
    assert Counter(map(tuple, store.read().collect())) == want
    assert Counter(map(tuple, before.collect())) == want  # readers of the older version keep their files
    assert store.read(1).count() < store.read(2).count()
    with pytest.raises(sharding.CommitConflict):
        store.commit(made[-1], last.schema, [])
    store.append(table.drop("arrival").limit(10))
    assert store.read().count() == table.count() + 10
    gone = store.vacuum()
    assert gone > 0 and store.read().count() == table.count() + 10
    with pytest.raises(ValueError, match="schema"):
        store.append(table)


def test_shards_of_one_name_keep_their_rows(spark):
    rows = docs(spark, [(k, words(12, k)) for k in range(400)]).coalesce(1).withColumn("arrival", F.lit(9)).withColumn("shard", F.lit("own"))
    for fanout in (100, 4):
        store = sharding.ShardStore(spark, scratch(spark, "t"), target_bytes=1 << 20, fanout=fanout)
        found = queries.stored(rows, store).collect()
        assert Counter(r.doc_id for r in found) == Counter(range(400))
        assert {r.shard: r.shard_bytes for r in found} == {s.path: s.bytes for s in store.manifest().shards}
        assert store.read().select("arrival").distinct().collect()[0][0] == 9
    assert queries.stored(rows.limit(0), sharding.ShardStore(spark, scratch(spark, "t"))).count() == 0


def test_empty_store(spark):
    store = sharding.ShardStore(spark, scratch(spark, "t"))
    assert store.read().count() == 0 and store.compact().version == 0
    store.append(docs(spark, []))
    assert store.read().columns == ["doc_id", "text", "lang", "source", "n_chars"]


# --- packing ---


def test_packing_keeps_every_token(spark):
    rows = [(k, (words(int(RNG.integers(0, 900)), k) + ". ") * (k % 3)) for k in range(40)] + [(90, words(9000, 1)), (91, None), (92, ""), (93, "one"), (None, "one"), (None, "one")]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    found = packing.pack(docs(spark, rows).coalesce(2).withColumn("start", F.lit(7)), VOCABULARY).toPandas()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows if i is not None}
    for i, own in ids.items():
        pieces = found[found.doc_id == i].sort_values("start")
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(own)
    for _, window in found.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert (window.offset == window.length.cumsum() - window.length).all()
        total = window.length.sum()
        assert total <= 2048
        assert (window.padding == (0 if total & (total - 1) == 0 else 2048 - total)).all()
    used = found.groupby("sequence_id").length.sum()
    assert (2048 - used).sum() / (2048 * len(used)) < 0.1  # two short last windows among some forty
    assert packing.pack(docs(spark, []), VOCABULARY).count() == 0


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(9)
    for _ in range(30):
        pos = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 14))])
        price = rng.integers(0, 5, len(pos)).astype(float)
        best = np.full(len(pos), np.inf)
        best[0] = 0
        for j in range(1, len(pos)):
            for i in range(j):
                if pos[j] - pos[i] <= 16:
                    best[j] = min(best[j], best[i] + 16 - (pos[j] - pos[i]) + price[j])
        cuts = packing.best_cuts(pos, price, 16)
        cost, last = 0.0, 0
        for c in cuts:
            assert pos[c] - pos[last] <= 16
            cost += 16 - (pos[c] - pos[last]) + price[c]
            last = c
        assert last == len(pos) - 1 and cost == pytest.approx(best[-1])


def test_word_tokens_equal_the_tokenizer():
    mine = packing.WordTokens(VOCABULARY)
    for text in ("", "Don't it's WE'LL", "É é ΑΣ Σας İstanbul", "日本語 test, 123.45 a1b2 ...", "​x ﬁ Ǆ ß", "a|b |||.,;", "a\x1cb\x85c\xa0d", "é café."):
        assert np.frombuffer(mine.text(text), "<u4").tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_tokens_know_added_tokens():
    mine, fresh = packing.WordTokens(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert np.frombuffer(mine.text("see <|endoftext|> here"), "<u4").tolist() == [862, 49407, 763]
    for token in ("<|endoftext|>", "<|startoftext|>"):
        for form in ("{}", "see {} here", "a{}b", "don{}'t", "Hello{}World {}", "{}{}", "x<|{}|>", "É{}日", "{}\x1ca", "a\n{}\tb", "a\u200b{}", "e{}\u0301"):
            text = form.replace("{}", token)
            for t in (text, text.upper(), text.replace("|>", "| >")):
                assert np.frombuffer(mine.text(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids


# --- language model ---


def test_forward_and_expectations_by_enumeration():
    rng = np.random.default_rng(3)
    draw = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    model = hmm.HiddenMarkov(draw(2), draw(2, 2), draw(2, 3))
    texts = [np.array(t, np.int32) for t in ([0, 1, 2, 1], [2], [1, 1])]
    from itertools import product

    for text, got in zip(texts, hmm.log_likelihood(model, texts), strict=True):
        total = 0.0
        for path in product(range(2), repeat=len(text)):
            p = model.start[path[0]] * model.emit[path[0], text[0]]
            for t in range(1, len(text)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], text[t]]
            total += p
        assert got == pytest.approx(np.log10(total))
    texts += [rng.integers(0, 3, n) for n in (9, 40, 3)]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for text in texts:  # the plain recursion, a text at a time
        a, b = [model.start * model.emit[:, text[0]]], [np.ones(2)]
        for x in text[1:]:
            a.append(a[-1] @ model.move * model.emit[:, x])
        for x in text[:0:-1]:
            b.insert(0, model.move @ (model.emit[:, x] * b[0]))
        whole = a[-1].sum()
        start += a[0] * b[0] / whole
        for t, x in enumerate(text):
            emit[:, x] += a[t] * b[t] / whole
            if t:
                move += a[t - 1][:, None] * model.move * model.emit[:, x] * b[t] / whole
    for most in (1, 5, 16, 1000):
        sums = hmm.expectations(model, texts, most)
        assert np.allclose(sums.start, start) and np.allclose(sums.move, move) and np.allclose(sums.emit, emit)


def test_language_model_scores(spark):
    rows = [(k, words(60, k % 10, "en" if k % 2 else "fr")) for k in range(80)] + [(None, None), (200, ""), (201, "ÀB ab\x0bAB unknown")]
    table = docs(spark, rows)
    counts = hmm.count_words(table)
    held = hmm.vocabulary(counts, table.count(), symbols=50, sent=120)
    model = hmm.fit(hmm.tokenised(table, held), held, states=3)
    got = hmm.score(hmm.tokenised(table.withColumn("word", F.lit(1)), held), held, model, counts).toPandas()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low)), None] for i, t in rows}
    n = Counter(w for t in tokens.values() for w in t)
    for r in got.itertuples():
        own = tokens[None if np.isnan(r.doc_id) else int(r.doc_id)]
        assert r.n_tokens == len(own) and r.n_known == len(own) and r.train_tokens == sum(n.values())
        assert r.base_score == pytest.approx(sum(np.log10((n[w] + 0.1) / (sum(n.values()) + 0.1 * (len(n) + 1))) for w in own))
        assert r.score < 0
    assert got.score.sum() > got.base_score.sum()
    assert hmm.score(hmm.tokenised(awkward(spark), held), held, model, counts).count() == len(AWKWARD)
    none = table.limit(0)
    held = hmm.vocabulary(hmm.count_words(none), 0)
    tokens = hmm.tokenised(none, held)
    assert hmm.score(tokens, held, hmm.fit(tokens, held, states=3), counts).count() == 0
    assert hmm.score(hmm.tokenised(awkward(spark), held), held, hmm.fit(tokens, held, states=3), counts).count() == len(AWKWARD)
    # All words, an unknown one of each class included, have probability 1 in every state.
    assert model.emit.sum(axis=1) == pytest.approx(np.ones(3))


# --- nearest neighbours ---


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 24))
    x[700:1100] = x[700]  # a third are copies
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(9000, None, 0), (9001, [0.0] * 24, 0), (9002, [float("nan")] * 24, 0), (9003, [None] * 24, 0), (9004, [1.0, 2.0], 0), (9020, [3.0, 1.0], 0)]
    vectors = ann.valid_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), "vec_id", "embedding").persist()
    assert vectors.count() == 1502
    book = ann.fit(vectors)
    found = ann.search(vectors, vectors.where("vec_id % 20 = 0"), book, k=10, block_rows=400, block_queries=30).toPandas()
    hits = total = 0
    for q in range(0, 1500, 20):
        score = x @ x[q]
        best = sorted((k for k in range(1500) if k != q), key=lambda k: (-score[k], k))[:10]
        got = found[found.query_id == q].sort_values("rank")
        assert list(got["rank"]) == list(range(1, 11))
        assert np.allclose(got.score, [score[k] for k in got.vec_id])
        hits += len({*got.vec_id} & {*best})
        total += 10
    assert hits / total > 0.95
    copies = found[found.query_id == 720].sort_values("rank").vec_id.tolist()
    assert copies == list(range(700, 710))
    assert found[found.query_id == 9020].vec_id.tolist() == [9004]


def test_neighbours_of_single_precision_and_no_vectors(spark):
    x = np.random.default_rng(6).standard_normal((300, 9)).astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    vectors = ann.valid_vectors(table, "vec_id", "embedding")
    book = ann.fit(vectors, parts=3)
    found = ann.search(vectors, vectors.where("vec_id < 7"), book, k=5, rerank=60, block_rows=100, block_queries=3).toPandas()
    assert len(found) == 35
    exact = x.astype(np.float64) @ x[:7].astype(np.float64).T
    assert found.score.tolist() == pytest.approx([exact[v, q] for q, v in zip(found.query_id, found.vec_id)], abs=1e-12)
    assert sum(len({*rows.vec_id} & {*sorted({*range(300)} - {q}, key=lambda v: -exact[v, q])[:5]}) for q, rows in found.groupby("query_id")) > 31
    assert ann.search(vectors.limit(0), vectors, book).count() == ann.search(vectors, vectors.limit(0), book).count() == 0
    assert ann.fit(vectors.limit(0)) is None


# --- archives ---


def test_archives_round_trip(spark):
    html = ["<p>é\n</p>", "", None, "same", "same", "same", "x\r\n\r\ny\r\nWARC/1.1\r\n", "z" * 5000]
    rows = [(k, f"http://a b.example/{k}?q=ü" if k % 2 else None, h) for k, h in enumerate(html)] + [(None, "u", "lone"), (None, "u", "same"), (3, "again", "same"), (1 << 60, "big", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(pages, arc, file_bytes=300)
    versions = {len(r.mime.split()) for r in warc.read_arc(spark, arc).collect()}
    assert versions == {1}
    warc.convert(spark, arc, out, file_bytes=300)
    got = warc.read_warc(spark, out).collect()
    assert len(got) == len(rows)
    first = {"same": 3, "": 1}
    want = Counter()
    for page, _, h in rows:
        data = (h or "").encode()
        lead = first.get(h or "")
        kind = "response" if lead is None or page == lead else "revisit"
        want[page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, lead if kind == "revisit" else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.payload for r in got if r.page_id == 6} == {html[6]}
    assert len({r.record_id for r in got}) == len(got)
    names = {(r.page_id, r.record_id) for r in got}
    heads = [h for f in spark.read.format("binaryFile").load(out).collect() for h, _ in warc.warc_records(gzip.decompress(f.content)) if h["WARC-Type"] == "revisit"]
    assert len(heads) == sum(r.record_type == "revisit" for r in got)
    assert all((int(h["X-Refers-To-Page"]), h["WARC-Refers-To"]) in names and h["WARC-Refers-To-Target-URI"] and h["WARC-Refers-To-Date"] for h in heads)


@pytest.mark.parametrize("rows", [[], [(7, "u", "x"), (7, "u", "x")]])
def test_archives_of_empty_tables_and_partitions(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.limit(0).union(pages.coalesce(1))  # the first partitions are empty
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(pages, arc)
    warc.convert(spark, arc, out)
    got = warc.read_warc(spark, out).collect()
    assert [(r.page_id, r.record_type) for r in got] == [(7, "response")] * len(rows) and len({r.record_id for r in got}) == len(rows)


def test_both_arc_versions_parse():
    for version in (1, 2):
        data = (warc._arc_head(version, "n.arc") + warc._arc_record(version, "n.arc", "5", "http://x/", "héllo\n", "20200101000000")).encode()
        ((head, block),) = warc.arc_records(data)
        assert head["URL"] == "http://x/" and len(head) == (5 if version == 1 else 10)
        assert warc._payload(block) == (5, "héllo\n".encode())
    with pytest.raises(ValueError, match="declares"):
        list(warc.arc_records(data[:-10]))


def test_revisits_by_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    rows = spark.createDataFrame([(k, "u", f"d{k % 3}", 4, f"r{k}", "d") for k in range(30)] + [(40, "u", "solo", 4, "r", "d")], "page_id bigint, url string, payload_digest string, payload_bytes bigint, record_id string, date string")
    got = {r.page_id: r.refers_to for r in warc.mark_revisits(rows).collect()}
    assert got == {k: (None if k < 3 else k % 3) for k in range(30)} | {40: None}


# --- language identification ---


def test_languages_and_awkward_rows(spark):
    rows = [(k, words(40, k), "aa", "s", 0) for k in range(30)] + [(50 + k, words(40, k, "xyz"), "bb", "s", 0) for k in range(30)]
    rows += [(200, words(40, 7777, "xyz"), None, "s", 0), (201, None, "aa", "s", 0), (202, "123 ??", "aa", "s", 0), (203, "", "bb", "s", 0)]
    table = spark.createDataFrame(rows, DOCS)
    profiles = langid.language_profiles(table)
    got = {r.doc_id: r for r in langid.identify(table, profiles).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _, _ in rows[:60])
    assert got[200].lang_pred == "bb" and 0 < got[200].score < 1
    assert {got[i].lang_pred for i in (201, 202, 203)} == {"und"}
    assert langid.identify(awkward(spark), profiles).count() == len(AWKWARD)
    none = langid.identify(table, profiles.limit(0)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_gram_counts_by_brute_force():
    texts = ["Ab, ba!", "", "éa 1 b", "日本 x"]
    owner, gram, count = langid.gram_counts(texts, np.arange(4))
    got = {(o, tuple(c for c in ((g >> 42), (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if c)): n for o, g, n in zip(owner.tolist(), gram.tolist(), count.tolist(), strict=True)}
    want = Counter()
    for o, t in enumerate(texts):
        s = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        for k in range(len(s)):
            for n in (1, 2, 3):
                piece = s[k : k + n]
                fine = len(piece) == n and {1: piece != " ", 2: piece.strip() != "", 3: n == 3 and len(piece) == 3 and piece[1] != " "}[n]
                if fine:
                    want[o, tuple(map(ord, piece))] += 1
    assert got == dict(want)
