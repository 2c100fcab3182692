"""Registered queries of the subpackage: every operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.byte_bpe import byte_bpe
from tidepool.llm.chat import (PART, flatten_parts, format_conversations, masked_text,
                               parse_formatted)
from tidepool.llm.decontaminate import with_hits
from tidepool.llm.embedding_join import embedding_near_duplicates
from tidepool.llm.importance import importance_resample
from tidepool.llm.ngram_join import near_duplicate_groups
from tidepool.llm.oracles import ORACLES  # noqa: F401
from tidepool.llm.packing import pack_documents
from tidepool.llm.quality_gbt import quality_scores
from tidepool.llm.quality_rules import quality_rules
from tidepool.llm.suffix_dedup import remove_repeats
from tidepool.llm.token_count import token_counts
from tidepool.llm.vector_codes import vector_codes
from tidepool.llm.warc import resolve_revisits


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, length=50, gram=24)


def op4_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(_table(spark, sf_dir, "documents"),
                    public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                    public_tokenizers.PATTERN)


def capture_records(pages: DataFrame) -> DataFrame:
    """Stand-in input of op6: per page a response record and a revisit record
    of the same page under another spelling of its URL, at other times, with
    an entity tag, only a date, another tag or no validator."""
    n = F.col("page_id")
    first = (n * 7919) % 1000003
    again = first + F.pmod(n * 31, F.lit(9)) * 3600 - 3600
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 12), F.lit('"'))
    modified = F.concat(F.lit("day "), (n % 50).cast("string"))
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    response = pages.select(
        F.concat(F.lit("r"), n).alias("record_id"), F.lit("response").alias("record_type"), "url",
        at(first).alias("captured_at"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), modified,
                     F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"),
                     first.cast("string")).alias("headers"), F.col("html").alias("payload"))
    revisit = pages.select(
        F.concat(F.lit("v"), n).alias("record_id"), F.lit("revisit").alias("record_type"),
        F.concat(F.regexp_replace("url", "^https?://", "HTTP://www."), F.lit("#again"))
        .alias("url"),
        at(again).alias("captured_at"), F.lit(304).alias("status"),
        F.when(n % 4 < 2, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"),
                                       again.cast("string"), F.lit("content-length"), F.lit("0")))
        .when(n % 8 == 2, F.create_map(F.lit("ETag"), F.lit('"changed"')))
        .when(n % 4 == 2, F.create_map(F.lit("last-modified"), modified, F.lit("cache-control"),
                                       F.lit("max-age=60")))
        .otherwise(F.create_map(F.lit("date"), again.cast("string"))).alias("headers"),
        F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(capture_records(_table(spark, sf_dir, "pages")))
    shown = F.array_join(F.transform("headers", lambda h: F.concat_ws(
        ": ", h["name"], h["value"])), "\n")
    return out.select("record_id", "url_key", F.unix_micros("captured_at").alias("captured_us"),
                      "resolution", "resolved_id", "status", shown.alias("headers"),
                      "payload_sha256", "payload_bytes")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, sf_dir, "documents"), percent=75, words=5).select(
        "doc_id", "n_shingles", "component_id")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"), bound=0.93)


# Fixed value: both texts of the added conversation -7.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"))
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"),
                    *[F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages")])
    turns = rows.union(extra).select("conv_id", "turn", "role",
                                     F.array(part.cast(PART)).alias("parts"))
    out = format_conversations(flatten_parts(turns)).withColumns({
        "turns": parse_formatted(F.col("formatted")),
        "loss_text": masked_text(F.col("formatted"), F.col("loss"))})
    shown = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(shown.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25,
        min_words=20).select("doc_id", "n_features", "weight", "score", "rank")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_hits(docs, _table(spark, sf_dir, "benchmark"), "hits", window=10)
    ids = F.array_join(F.array_sort(F.col("hits.items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_gbt": op4_quality_gbt,
    "op10_quality_rules": op10_quality_rules,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_chat_format": op9_chat_format,
    "op5_byte_bpe": op5_byte_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_decontamination": op13_decontamination,
}
