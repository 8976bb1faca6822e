"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .filter_audit import filter_audit
from .html_extract import extract_main_text
from .jaccard_join import jaccard_groups
from .lexical_search import lexical_search
from .oracles import ORACLE_SQL
from .packing import pack
from .pii import KINDS, pseudonymise
from .quality_classifier import fold_zero, score_quality
from .quality_rules import quality_rules
from .sharding import byte_shards
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_suffixes
from .toxicity import score_toxicity


#: The pseudonyms' key in the registered queries; a real run passes its own secret.
PII_KEY = "registered-query-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of near equal bytes."""
    done = byte_shards(table(spark, sf_dir, "documents"), shards=8)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a 50-byte string of an earlier document covers."""
    done = dedup_suffixes(table(spark, sf_dir, "documents"), window=50)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores, learnt from positives and unlabelled texts outside the held-out fold."""
    done = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=fold_zero())
    return done.select("doc_id", fold_zero().alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 2048 tokens."""
    done = pack(table(spark, sf_dir, "documents"), window=2048, end_id=1)
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers by language and source."""
    done = quality_rules(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data, and how many of each kind were found."""
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)
    of_kind = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", F.size("pii").cast("long").alias("n_found"), *counts, "text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words inside 10-word windows of benchmark items."""
    done = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return done.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a 5-word shingle similarity of 0.75 or more."""
    return jaccard_groups(table(spark, sf_dir, "documents"), size=5, percent=75)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 50-word window of an earlier document covers."""
    done = dedup_substrings(table(spark, sf_dir, "documents"), window=50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores, learnt from votes and from labels outside the held-out fold."""
    done = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=fold_zero())
    return done.select("doc_id", fold_zero().alias("held_out"), "score", "predicted")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and cost in each of their orders, by language."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_extract": op9_html_extract,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_toxicity": op12_toxicity,
    "op13_filter_audit": op13_filter_audit,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
