"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redtide.llm import balltree, classifier, lines, packing, quality, sentencepieces, simhash, substrings, suffixes, syncmers, token_files, warc, whitening
from redtide.llm.shared import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the line field on every document."""
    docs = documents(spark, sf_dir)
    field = quality.fit_on(docs, documents(spark, sf_dir, "labels"))
    return quality.judge(docs, field)


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as byte planes and read back."""
    return token_files.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written as archives and read back."""
    found = warc.round_trip(documents(spark, sf_dir, "pages")).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = """
WITH own AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM own),
largest AS (SELECT hex, max(page_id) AS top FROM hashed GROUP BY hex),
groups AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(v AS int), 1), '' ORDER BY k) AS digest
  FROM (SELECT hex, k, list_sum(list_transform([0, 1, 2, 3, 4], lambda j: (1 << (4 - j)) * ((instr('0123456789abcdef', substr(hex, 1 + (5 * k + j) // 4, 1)) - 1) >> (3 - (5 * k + j) % 4) & 1))) AS v
    FROM (SELECT DISTINCT hex FROM hashed), range(32) AS r(k)) GROUP BY hex)
SELECT page_id, payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM hashed JOIN largest USING (hex) JOIN groups USING (hex)"""


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words outside windows of 35 words that occur more than once."""
    found = substrings.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes outside strings of 400 bytes that occur more than once."""
    found = suffixes.remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    found = syncmers.edited_likeness(documents(spark, sf_dir))
    return found.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents but for repeated and nearly repeated ones."""
    found = lines.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and the texts decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = sentencepieces.decode(sentencepieces.encode(documents(spark, sf_dir), model), model)
    return found.select("doc_id", "n_tokens", "ids_crc32", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return balltree.ranked_search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = """
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, string_split_regex(lower_text, '[^0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents)),
occurring AS (SELECT k, doc_id, unnest(words) AS term FROM docs),
tfs AS (SELECT k, doc_id, term, count(*) AS tf FROM occurring WHERE term <> '' GROUP BY k, doc_id, term),
sizes AS (SELECT k, sum(tf)::BIGINT AS n FROM tfs GROUP BY k),
totals AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sizes),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM dfs, totals),
asked AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM benchmark) WHERE term <> '' GROUP BY item_id, term),
scored AS (SELECT item_id, k, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (k), totals GROUP BY item_id, k, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    found = whitening.whiten(documents(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


@query
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = documents(spark, sf_dir)
    return classifier.score(docs, classifier.fit_on(docs, documents(spark, sf_dir, "labels")))
