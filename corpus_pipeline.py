"""Corpus pipeline: quality rules, near duplicates, personal data, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of `documents`, and further columns under any name come through as they
are. An empty table gives an empty table. Null texts count as texts without words, null sources
as a source of their own; documents without an id are never taken for copies.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import mixing, pieces, pii, quality, similar
from meterlake.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; repeated rows that are kept stay."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard 0.8 or more) stays, the one with the smallest id.

    Texts without words, null ones too, are one group. A repeated id keeps one row; rows without an id all stay.
    """
    return similar.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows. Every row stays; a null text stays null."""
    return pii.mask_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, put in the order of the mixing schedule."""
    return mixing.in_mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256, mix_slot, mix_block_row) of every whole text.

    Files keep no order, so the place in the mixing schedule is worked out again: it follows from
    the sources and ids of the documents alone. Read in order of mix_slot, mix_block_row. A null
    text is encoded as an empty one.
    """
    placed = mixing.mix_sources(docs.select("doc_id", "source", "text"))
    keyed = placed.select(F.struct("doc_id", "mix_slot", "mix_block_row").alias("key"), "text")
    found = pieces.encode_digests(keyed, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, id_col="key")
    return found.select("key.doc_id", *[c for c in found.columns if c != "key"], "key.mix_slot", "key.mix_block_row")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: SQL can't express groups of near copies at this size, or SentencePiece; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored as Parquet in the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
