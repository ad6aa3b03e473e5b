"""Queries of operators 2, 4, 5, 7, 9 and 10."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, html_text, imatch, jaccard, mil, training_order
from barloom.llm.common import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents"), TOKENIZER)
    out = bpe.decode(coded, TOKENIZER, ["doc_id", "n_tokens", "ids"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    scored = mil.score(docs, mil.train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_groups(read(spark, sf_dir, "documents"), k=3, percent=90)


QUERIES = {
    "op2_html_extraction": op2_html_extraction,
    "op4_training_order": op4_training_order,
    "op5_fingerprints": op5_fingerprints,
    "op7_bpe": op7_bpe,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_jaccard_join": op10_jaccard_join,
}
SQL: dict[str, str] = {}
