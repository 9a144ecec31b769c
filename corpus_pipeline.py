"""A corpus from raw documents to packed sequences, one table for each stage.

Every stage takes all rows its predecessor kept and returns the columns of the documents it got, in their
order, with `n_chars` following the text; the last one returns pieces in sequences. Null texts count as
empty. Rows are told apart by all their columns, so null and repeated ids lose no text. Extra columns are
carried along whatever their names are. An empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redtide.llm import likeness, lines, packing, quality, substrings
from redtide.session import written

#: Near duplicates of this pipeline: sets of runs of five words with a Jaccard likeness of at least 0.8.
SHINGLE, LEAST_LIKENESS = 5, 0.8

ORACLE_SQL = None  # the line field, near duplicates and the tokenizer have no SQL form; tests/llm has the brute force


def _carried(docs: DataFrame, run: Callable[[DataFrame, tuple[str, ...]], DataFrame]) -> DataFrame:
    """`run` on (doc_id, text, extra_0, extra_1, ...), and its rows with the columns of `docs`."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    safe = {c: f"extra_{k}" for k, c in enumerate(others)}
    slim = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(s) for c, s in safe.items()])
    out = run(slim, tuple(safe.values()))
    size = {"n_chars": F.char_length("text").cast("bigint")} if "n_chars" in others else {}
    return out.select([size.get(c, F.col(safe.get(c, c))).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _carried(docs, lambda d, extra: quality.judge(d, field, extra=extra).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _carried(docs, lambda d, extra: lines.dedup_lines(d, extra=extra).withColumnRenamed("kept", "text"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least (doc_id, text hash) of each group of near copies, null ids last; an id alone joins no rows.

    Copies are proposed by SimHash with pigeonring, and by keys where their fingerprints are further apart."""

    def keep(d: DataFrame, extra: tuple[str, ...]) -> DataFrame:
        whole = F.to_json(F.struct("doc_id", *extra))
        keys = [F.xxhash64("text").alias("h"), F.xxhash64(whole, "text").alias("g")]
        found = likeness.classes(d.select(*keys, F.col("doc_id").alias("id"), "text"), SHINGLE, LEAST_LIKENESS)
        first = found.groupBy("root").agg(F.min(F.struct(F.isnull("id").alias("unnamed"), "id", "h", "g")).alias("kept"))
        return d.select("*", *keys).join(first.select("kept.h", "kept.g"), ["h", "g"], "left_semi").dropDuplicates(["h", "g"])

    return _carried(docs, keep)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _carried(docs, lambda d, extra: substrings.remove_repeats(d, extra=extra, spaced=False).withColumnRenamed("kept", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written in the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == STAGES[-1][0] else written(docs)
    return docs
