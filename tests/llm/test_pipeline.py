"""The corpus pipeline on awkward rows, an empty table, and planted cases against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, DOCS, brute_classes, brute_contained, edited, plain_spans, words

import corpus_pipeline
from graphloom.llm.common import scratch


def folder(spark, rows, bench, extra=()):
    path = scratch(spark, "sf")
    made = spark.createDataFrame(rows, DOCS)
    for name in extra:
        made = made.withColumn(name, F.lit(1))
    made.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stages(spark, path):
    """What each stage keeps, by its name."""
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch(spark, "stage")
        stage(spark, docs, path).write.parquet(out)
        docs = kept[name] = spark.read.parquet(out)
    return kept


def test_stages_keep_what_brute_force_keeps(spark):
    item = words(15, 5001)
    rows = [(k, edited(words(80, k // 3), k % 3, k) + " end.", "en", "s", 0) for k in range(30)]
    rows += [(100 + k, words(60, 50 + k) + " " + item + " " + words(60, 70 + k), "en", "s", 0) for k in range(4)]
    rows += [(200, words(60, 90) + " me@mail.example.com and +1 (555) 123-4567 at 10.0.0.1 end", "en", "s", 0), (300, "12 34 !", "en", "s", 0), (301, None, "en", "s", 0)]
    path = folder(spark, rows, [(1, item), (2, words(9, 5002))])
    kept = stages(spark, path)
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert {r.doc_id for r in kept["language"].collect()} == {r[0] for r in lettered}
    classes = brute_classes([r[:2] for r in lettered])
    assert {r.doc_id for r in kept["near-duplicates"].collect()} == set(classes.values())
    left = [r for r in lettered if r[0] in set(classes.values())]
    bad = {d for d, _ in brute_contained([r[:2] for r in left], [(1, item)])}
    clean = {r.doc_id: r.text for r in kept["decontamination"].collect()}
    assert clean == {r[0]: r[1] for r in left if r[0] not in bad} and len(bad) == 4
    redacted = {r.doc_id: r for r in kept["personal data"].collect()}
    assert set(redacted) == set(clean) and not any(plain_spans(r.text) for r in redacted.values())
    assert all(r.text == clean[i] for i, r in redacted.items() if i != 200)
    assert redacted[200].text == words(60, 90) + " [EMAIL] and [PHONE] at [IP] end" and redacted[200].n_chars == len(redacted[200].text)
    pieces = kept["packing"].collect()
    assert {p.doc_id for p in pieces} == set(clean)
    assert all(sum(p.length for p in pieces if p.doc_id == i) == next(p.doc_tokens for p in pieces if p.doc_id == i) for i in clean)
    for names in ("language", "near-duplicates", "decontamination", "personal data"):
        assert kept[names].columns == list(corpus_pipeline.COLUMNS)
    assert Counter(p.doc_id for p in corpus_pipeline.run(spark, path).collect()) == Counter(p.doc_id for p in pieces)


@pytest.mark.parametrize("rows", [[], [(i, t, lang, None, None) for i, t in AWKWARD for lang in ("en", None)]])
def test_awkward_rows_and_empty_tables_pass_all_stages(spark, rows):
    path = folder(spark, rows, [(1, "quite another item of eight words or more"), (None, None)] if rows else [], ("node", "bands", "score", "bucket", "_text", "redacted", "label"))
    kept = stages(spark, path)
    counts = [kept[name].count() for name in kept]
    assert counts[:4] == ([10, 3, 3, 3] if rows else [0] * 4)
    assert (counts[4] > 0) == bool(rows)
    tokens = np.array([p.length for p in kept["packing"].collect()])
    assert (tokens > 0).all()
