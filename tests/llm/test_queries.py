"""The registered queries' digest columns against plain computations, over a small table with awkward rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import queries

DATA = "/root/testdata/sf0.001"
ODD = [
    (900001, None), (900002, ""), (900003, " \t\n"), (900004, "12 34 !!"), (900005, "Write to a.b@c.example.org, or +44 (20) 7946-0958; from 10.0.0.255 and 10.0.0.256."),
    (900006, "card 4111 1111 1111 1111 and 4111-1111-1111-1112 é 🙂 x@y.z"), (900007, "Word WORD word\x0bword word \u0085 end"), (900008, "long " * 3000),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with awkward and repeated rows and clashing columns, labels, and pages with equal and null payloads."""
    place = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in ODD], docs.schema)
    rows = docs.unionByName(odd).withColumn("score", F.lit("own")).withColumn("text_", F.lit(1)).withColumn("held_out", F.lit("own"))
    rows.write.parquet(f"{place}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{place}/labels.parquet")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    more = spark.createDataFrame([(800001, "http://a.example/", None), (800002, "http://a.example/2", ""), (800003, "http://b.example/", "é" * 40), (800004, "http://b.example/4", "é" * 40)], pages.schema)
    pages.unionByName(more).write.parquet(f"{place}/pages.parquet")
    return place


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_quality_rows(spark, folder, texts):
    found = queries.op3_quality(spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def base_spans(text):
    """The contract's patterns, by kind and start."""
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda t: re.sub("[^0-9]", "", t)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (pattern, fits) in rules.items() for m in re.finditer(pattern, text) if fits(m[0])]


def test_personal_data_rows(spark, folder, texts):
    found = queries.op4_pii(spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        base = [f"{k}:{a}:{b}" for k, a, b in base_spans(texts[r.doc_id])]
        spans = r.spans.split(",") if r.spans else []
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and {*base} <= {*spans}
        kinds = Counter(s.split(":")[0] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))


def test_packed_rows(spark, folder, texts):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in queries.op6_packing(spark, folder).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = np.array([*model.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= 2048


def test_language_model_rows(spark, folder, texts):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for i, t in texts.items()}
    counts = Counter(w for i, own in words.items() if remainder(i, 10) for w in own)
    total, distinct = sum(counts.values()), len(counts)
    found = queries.op7_hmm(spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        own = words[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 10) == 0, len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_archive_rows(spark, folder):
    given = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    first = {}
    for i in sorted(given):
        first.setdefault(given[i], i)
    wanted = {}
    for i, data in given.items():
        lead = first[data]
        wanted[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if lead == i else "revisit", None if lead == i else lead)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op9_warc(spark, folder).collect()} == wanted


def test_language_rows(spark, folder, texts):
    found = queries.op10_language(spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    known = {r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang").distinct().collect()} - {None}
    for r in found:
        lettered = any(c.isalpha() for c in texts[r.doc_id])
        assert r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert r.lang_pred in known if lettered else r.lang_pred == "und"
