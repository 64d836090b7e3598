"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import ann, bpe, hmm, pii, vectorcode, warc
from graphloom.llm.common import id_hash, scratch
from graphloom.llm.decontaminate import contaminated
from graphloom.llm.langid import identify, language_profiles
from graphloom.llm.neardup import near_duplicates
from graphloom.llm.packing import pack
from graphloom.llm.quality import fit_quality, score_quality
from graphloom.llm.runs import periodic_runs
from graphloom.llm.sharding import ShardStore


#: Shards whose sizes are sent to all tasks at most; beyond, rows meet them in a shuffle.
SENT_SHARDS = 100_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, at a similarity of 0.8."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents and benchmark items that they contain to 0.8 or more."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression classifier over all documents; every fifth id hash is held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.pmod(id_hash(), F.lit(5)) == 0
    model = fit_quality(docs, labels.where(~held_out))
    scored = score_quality(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "difference")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and model spans of personal data in all documents."""
    docs = _table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit(docs))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended in four arrivals, compacted, and read back by the last manifest.

    Per document: the digest of the text as it was read back, its shard, that shard's
    bytes by the manifest, and the version.
    """
    return stored(_table(spark, sf_dir, "documents"), ShardStore(spark, scratch(spark, "shards"), target_bytes=64 << 20))


def stored(docs: DataFrame, store: ShardStore) -> DataFrame:
    """The rows of ``op5_sharding`` for a new store; columns of docs other than those returned are stored too."""
    arrival = "arrival"
    while arrival in docs.columns:
        arrival += "_"
    store.append(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(4))), by=arrival)
    last = store.compact()
    store.vacuum()
    listed = docs.sparkSession.createDataFrame([(s.path, s.bytes) for s in last.shards], "shard string, shard_bytes bigint")
    if len(last.shards) <= SENT_SHARDS:
        listed = F.broadcast(listed)
    rows = store.read(last.version, shard="shard").join(listed, "shard", "left")
    return rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_chars", "shard", "shard_bytes", F.lit(last.version).alias("version"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens, cut by dynamic programming."""
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents; one id hash in ten is held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(id_hash(), F.lit(10)) == 0
    taught = docs.where(~held_out)
    counts = hmm.count_words(taught)
    words = hmm.vocabulary(counts, taught.count())
    tokens = hmm.tokenised(docs.withColumn("held_out", held_out), words, keep=("doc_id", "held_out"))
    model = hmm.fit(tokens.where("not held_out"), words)
    return hmm.score(tokens, words, model, counts, keep=("doc_id", "held_out"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    vectors = ann.valid_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    book = ann.fit(vectors)
    if book is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), book)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files, converted to WARC with revisits, and read back from the WARC files."""
    arc, archive = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(_table(spark, sf_dir, "pages"), arc)
    warc.convert(spark, arc, archive)
    return warc.read_warc(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-order language profiles over all documents; one id hash in four is held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(id_hash(), F.lit(4)) == 2
    profiles = language_profiles(docs.where(~held_out))
    return identify(docs.withColumn("held_out", held_out), profiles, keep=("doc_id", "held_out"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of all whole vectors, four parts with 256 entries each after four rounds."""
    return vectorcode.encode(_table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents and the bytes that they decode to, as digests."""
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, pattern)
    decoded = bpe.decode(encoded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens")), vocabulary, pattern, keep=("doc_id", "ids", "n_tokens"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """documents in which the words of every tenth text, by its id's hash, repeat from some word on."""
    h = id_hash()
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    g, n = F.floor(h / 10).cast("bigint"), F.size("_words").cast("bigint")
    docs = docs.select("doc_id", "text", words.alias("_words"), g.alias("_g"))
    docs = docs.select("*", F.when(n > 0, F.col("_g") % n).alias("_a"))
    period = 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))
    docs = docs.select("*", period.cast("int").alias("_p"), F.col("_a").cast("int").alias("_from"))
    again = F.array_repeat(F.slice("_words", F.col("_from") + 1, F.col("_p")), F.ceil((n - F.col("_a")) / F.col("_p")).cast("int"))
    whole = F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_from")), F.flatten(again)), F.lit(1), n.cast("int"))
    return docs.select("doc_id", F.when(F.col("_a").isNull(), F.col("text")).otherwise(F.array_join(whole, " ")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of all documents, with repetitions planted in a tenth of them, as counts and digests."""
    found = periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents")))
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda held, r: F.when(better(held, r), r).otherwise(held))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    top = [F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")]
    return rows.select("doc_id", "n_runs", *top, F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_neardup": op1_neardup,
        "op2_decontamination": op2_decontamination,
        "op3_quality": op3_quality,
        "op4_pii": op4_pii,
        "op5_sharding": op5_sharding,
        "op6_packing": op6_packing,
        "op7_hmm": op7_hmm,
        "op8_ann": op8_ann,
        "op9_warc": op9_warc,
        "op10_language": op10_language,
        "op11_vector_codes": op11_vector_codes,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_runs": op13_runs,
    }


_OP2_SQL = """
WITH words AS (
    SELECT doc_id AS id, FALSE AS item, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents
    UNION ALL
    SELECT item_id, TRUE, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') FROM benchmark
), shingles AS (
    SELECT DISTINCT id, item, array_to_string(w[k:k + 4], ' ') AS s
    FROM (SELECT id, item, w, unnest(range(1, len(w) - 3)) AS k FROM words)
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE item GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n) AS n_shingles, count(*) / any_value(n) AS containment
FROM shingles b JOIN sizes ON sizes.id = b.id JOIN shingles d ON d.s = b.s AND NOT d.item
WHERE b.item GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2_SQL}
