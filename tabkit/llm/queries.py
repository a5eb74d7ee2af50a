"""One registered query for each operator, over whole tables with production settings."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tabkit.llm import bpe, exact_dedup, jaccard, language, merkle, nearest, oracles, packing, quantise, sharding, substring_dedup, suffix_dedup, toxicity, warc
from tabkit.llm.frames import table
from tabkit.llm.registry import ORACLES, QUERIES, query  # noqa: F401

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), VOCABULARY, window=4096, end_id=2, keep_ids=False)
    return packing.pack(cut, window=4096)


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


NORMAL_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op3_exact_dedup",
    f"""
    WITH n AS (SELECT doc_id, {NORMAL_TEXT} AS norm FROM documents)
    SELECT doc_id,
           max(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept,
           sha256(norm) AS text_sha256
    FROM n WINDOW same AS (PARTITION BY norm)
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents")).drop("tid")


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight leaves of near equal bytes, split along language and size."""
    text = F.coalesce("text", F.lit(""))
    keys = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("_lang"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text_hash"),
    )
    sharded = sharding.kd_shards(
        keys,
        size=F.col("_size"),
        dimensions={"lang": sharding.text_coordinate(F.col("_lang")), "size": F.col("_size")},
        tie=F.col("_text_hash"),
        identity=F.col("doc_id"),
        shards=8,
    )
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), window=400)


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"), window=13)


@query("op6_nearest")
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), k=10)


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    offsets = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    # Offending character offsets beside the score, e.g. 12-18,40-47.
    return scored.select(
        "doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), F.array_join(offsets, ",").alias("spans")
    )


@query("op5_jaccard")
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("tid")


#: Captures that a crawler might have made of each page: two full responses and four
#: not-modified answers, one of them before any response and one with a stale tag.
CAPTURES = """
SELECT page_id * 6 + k AS record_id,
       CASE k WHEN 1 THEN concat(url, '#seen') WHEN 4 THEN replace(url, 'http://', 'HTTP://WWW.') ELSE url END AS uri,
       1700000000 + page_id % 10 + CASE k WHEN 0 THEN 100 WHEN 1 THEN 200 WHEN 2 THEN 50 WHEN 3 THEN 300 WHEN 4 THEN 400 ELSE 500 END AS captured_at,
       CASE WHEN k IN (0, 3) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE k WHEN 0 THEN concat('"', digest, '-0"') WHEN 1 THEN concat('W/"', digest, '-0"')
              WHEN 3 THEN concat('"', digest, '-1"') WHEN 5 THEN NULL ELSE concat('"', digest, '-0"') END AS etag,
       CASE k WHEN 5 THEN concat('day ', CAST(page_id % 28 + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)))
              WHEN 3 THEN concat('day ', CAST(page_id % 28 AS VARCHAR(20))) END AS last_modified,
       k, size
FROM (SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size, {each} AS k FROM {pages}) p
"""
IN_DUCKDB = {"each": "unnest(range(6))", "pages": "pages"}

CANONICAL = r"""
CASE WHEN regexp_matches(trim(uri), '{p}') THEN
  regexp_replace(lower(regexp_extract(trim(uri), '{p}', 1)), '^www[.]', '')
  || regexp_replace(regexp_extract(trim(uri), '{p}', 2), '^:(80|443)$', '')
  || regexp_replace(regexp_extract(trim(uri), '{p}', 3), '/+$', '') || '/'
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
       string_split(substring(regexp_extract(trim(uri), '{p}', 4), 2), '&'), lambda x: x <> '')), '&'), ''), '')
ELSE trim(uri) END
""".replace("{p}", warc.URL)


@query(
    "op8_warc",
    f"""
    WITH c AS (SELECT *, {CANONICAL} AS canonical_url, regexp_replace(etag, '^W/', '') AS tag FROM ({CAPTURES.format(**IN_DUCKDB)}) r),
    f AS (
      SELECT v.record_id, v.canonical_url, v.captured_at, v.tag, v.last_modified, v.k,
             r.record_id AS response_id, r.captured_at AS response_at, r.tag AS r_tag,
             r.last_modified AS r_modified, r.size, r.k AS r_k
      FROM c v LEFT JOIN c r
        ON r.record_type = 'response' AND r.canonical_url = v.canonical_url AND r.captured_at < v.captured_at
      WHERE v.record_type = 'revisit'
      QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.captured_at DESC NULLS LAST, r.record_id DESC) = 1
    ),
    s AS (
      SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
                     WHEN tag IS NULL AND last_modified IS NULL THEN 'no_validator'
                     WHEN tag IS NOT NULL AND tag IS DISTINCT FROM r_tag THEN 'etag_differs'
                     WHEN tag IS NULL AND last_modified IS DISTINCT FROM r_modified THEN 'modified_differs'
                     ELSE 'resolved' END AS status
      FROM f
    )
    SELECT record_id, canonical_url, captured_at, status, response_id, response_at,
           CASE WHEN status = 'resolved' THEN
             'age: 0' || chr(10) || 'cache-control: max-age=' || k || chr(10) || 'content-length: ' || size || chr(10)
             || 'content-type: text/html' || chr(10) || 'date: ' || captured_at || chr(10) || 'server: origin ' || r_k
           END AS headers
    FROM s
    """,
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = spark.sql(
        CAPTURES.format(each="explode(sequence(0, 5))", pages="{pages}"), pages=table(spark, sf_dir, "pages")
    )
    answered = F.create_map(
        *[F.lit("Date"), F.col("captured_at").cast("string")],
        *[F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("k").cast("string"))],
    )
    body = F.create_map(
        *[F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size").cast("string")],
        *[F.lit("Server"), F.concat(F.lit("origin "), F.col("k").cast("string"))],
    )
    none = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Age"), F.lit("0"))
    headers = F.map_concat(answered, F.when(F.col("record_type") == "response", body).otherwise(none))
    resolved = warc.resolve_revisits(captures.withColumn("headers", headers))
    lines = F.transform("headers", lambda e: F.concat(e["name"], F.lit(": "), e["value"]))
    return resolved.withColumn("headers", F.when(F.col("headers").isNotNull(), F.array_join(lines, "\n")))


@query("op11_codes", oracles.codebooks())
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantise.codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


@query("op12_language")
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a letter gets a learned language; what the calibrated limits would
    reject is told by ``accepted``."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, modulus=4, remainder=2))
    return found.select(
        "doc_id",
        language.held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        F.col("lang").alias("lang_pred"),
        "score",
        "accepted",
    )


@query("op13_merkle", oracles.merkle())
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, held against copies of which every third has lost its capitals."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proved = merkle.manifest(docs, claims={"text": tampered}, claimed=chosen)
    return proved.drop("lang", "proof")
