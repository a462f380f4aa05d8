"""The operators of this folder with production parameters, on their whole tables.

Each query only derives its digest columns from what its operator returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawharbor.llm import (
    bpe,
    brown,
    chat,
    langid,
    licenses,
    mixing,
    multiindex,
    neardup,
    phrases,
    pii,
    quality,
    wavelet,
    whitening,
)
from rawharbor.llm.common import table
from rawharbor.session import fresh_dir, small_table


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), "mix")
    return mixed.select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.repeats")).alias("taken"), "mix.repeats"
    )


def op2_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf, "documents").select("doc_id", "text"), "found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind_order"] < 4)

    def number(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.rendered(base), 256).alias("base_sha256"),
        pii.rendered(F.col("found")).alias("spans"),
    )


def op3_brown_scores(spark: SparkSession, sf: str) -> DataFrame:
    return brown.brown_scores(table(spark, sf, "documents"))


def op4_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_dir(spark, "token-shards")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    wavelet.write_tokens(table(spark, sf, "documents"), path, tokenizer, end_id=2)
    return wavelet.read_tokens(spark, path)


def op5_chat_windows(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = small_table(spark, [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    path = fresh_dir(spark, "chat-windows")
    chat.windows(rows).write.parquet(path)
    return chat.digests(spark.read.parquet(path))


def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents lie in a folder of their language inside one of their source."""
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")))
    return licenses.license_scan(docs, path)


def op7_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def coded(docs: DataFrame) -> DataFrame:
    """Ids of the whole texts, and what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_and_decode(docs, "ids", "decoded", ranks, public_tokenizers.PATTERN)


def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    rows = coded(table(spark, sf, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_embedding_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return multiindex.embedding_duplicates(table(spark, sf, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    verdicts = quality.quality_verdicts(docs, table(spark, sf, "labels"), "quality")
    return verdicts.select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.array_join("quality.rejected_by", ",").alias("rejected_by"),
    )


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    rows = whitening.whitened(table(spark, sf, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op13_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.language_ids(table(spark, sf, "documents"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_personal_data": op2_personal_data,
    "op3_brown_scores": op3_brown_scores,
    "op4_token_shards": op4_token_shards,
    "op5_chat_windows": op5_chat_windows,
    "op6_license_scan": op6_license_scan,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_embedding_duplicates": op9_embedding_duplicates,
    "op10_quality_rules": op10_quality_rules,
    "op11_whitening": op11_whitening,
    "op12_phrases": op12_phrases,
    "op13_language_id": op13_language_id,
}
