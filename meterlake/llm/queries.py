"""Queries of the operators over the test tables, with the columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, byte_bpe, chat, language, licenses, mixing, pieces, pii, quality, rules, simhash, topk, trie
from .common import table
from .oracle import ORACLE_SQL  # noqa: F401


def _joined_labels(matches: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        _joined_labels(base).alias("base_labels"), _joined_labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans_only(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), best.alias("top_score"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    names = {"q_words": "n_words", "q_word_chars": "word_chars", "q_symbols": "n_symbols", "q_dup_lines": "n_dup_lines", "q_repeat_words": "n_repeat_words"}
    return judged.select("doc_id", *[F.col(k).alias(v) for k, v in names.items()], "base_failed", "kept")


#: Documents of a block in the mix query.
MIX_BLOCK = 8


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights of 1 to 7, by the number in their names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    targets = docs.select("source").distinct().withColumn("weight", (1 + number % 7).cast("double"))
    mixed = mixing.mix_sources(docs, mixing.target_weights(targets), block_rows=MIX_BLOCK)
    return mixed.select("doc_id", "source", F.col("mix_row").alias("source_row"), F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_block_row").alias("block_row"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.turns_as_calls(table(spark, sf_dir, "conversations"))
    linked = chat.link_tool_calls(messages, {"reply": chat.REPLY}, chat.previous_calls(messages))
    return linked.withColumnRenamed("conv", "conv_id")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return trie.prefix_trie(turns, trie.head_plan(turns)).drop("turn_conv", "turn_index")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align_tokenizers(table(spark, sf_dir, "documents"), a, public_tokenizers.PATTERN, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_simhash, op3_pii, op4_topk, op5_quality_rules, op6_mix_sources, op7_quality_classifier, op8_language_id, op9_sentencepiece, op10_chat_format, op11_byte_bpe, op12_prefix_trie, op13_token_alignment)
}


