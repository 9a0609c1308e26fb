"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLE_SQL  # noqa: F401
from . import alignment, bpe, conversations, decontamination, html_text, near_dups, neighbours, pii, quality, reputation, sharding, token_counts, toxicity
from .common import table


def crc_is(modulus: int, remainder: int):
    """Condition that the CRC-32 of a key, written as text, has this remainder."""
    return lambda key: _remainder(key, modulus) == remainder


def _remainder(key: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus))


def _scored(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_is(3, 1)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), held_out)
    return _scored(quality.score_quality(docs, model), held_out)


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path names the document that the page shows; that document's quality label is its outcome."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) as long)").alias("doc_id")).where("doc_id is not null")
    outcomes = shown.join(labels.where("quality is not null").select("doc_id", F.col("quality").alias("good")), "doc_id").select("url", "good")
    return reputation.judge_urls(pages, outcomes)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda key: F.col(key) % 20 == 0, k=20)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_is(5, 0)
    weights = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), held_out)
    return _scored(toxicity.score_toxicity(docs, weights), held_out)


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit_pii(docs))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair_digests(conversations.damaged(rows), conversations=rows.select("conv_id").distinct())


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_url_reputation,
        op3_neighbours,
        op4_html_text,
        op5_token_counts,
        op6_toxicity,
        op7_near_dups,
        op8_bpe,
        op9_personal_data,
        op10_decontamination,
        op11_sharding,
        op12_conversation_repair,
        op13_token_alignment,
    )
}
