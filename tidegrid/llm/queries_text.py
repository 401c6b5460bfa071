"""Queries over the given tables for the operators that compute on whole texts in tasks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import language_id, lm_scoring, main_text, ngram_join, sentencepieces, toxicity
from tidegrid.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), PIECES, ids=False)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"), 4, 2)
    known = docs.filter(~out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.col("text").alias("t"), "lang")
    return language_id.predict(docs, language_id.fit(known)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"), 3, 1)
    # labels without a document, and documents without a label, play no part; the sample is picked by id before texts are joined
    known = table(spark, sf_dir, "labels").filter(~out).select("doc_id", "toxic")
    rows = docs.filter(~out).select("doc_id", F.col("text").alias("t")).join(known, "doc_id").withColumnRenamed("doc_id", "id")
    return toxicity.score(docs, toxicity.train(toxicity.sample(rows))).select("doc_id", out.alias("held_out"), "score", "predicted")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.score(table(spark, sf_dir, "documents"), good)


QUERIES = {
    "op2_main_text": op2_main_text, "op3_sentencepiece": op3_sentencepiece, "op4_language_id": op4_language_id,
    "op6_toxicity": op6_toxicity, "op7_lm_scoring": op7_lm_scoring, "op8_ngram_join": op8_ngram_join,
}
