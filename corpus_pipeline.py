"""From raw documents to token ids: five stages, each of them one operator of tidegrid.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads again as the
next stage's docs. All but the last return the columns of documents. Each stage works on all that the one before it kept:

1. quality rules: documents that the strict policy rejects go;
2. near duplicates: of each class of the n-gram join the document of least id stays;
3. decontamination: documents that hold a copy of a benchmark item go;
4. secret scans: secrets are replaced by a mark, and n_chars is counted again; no document goes;
5. SentencePiece: each document's ids, with digests of them and of the decoded text.

Defined cases: a null text counts as empty, which the quality rules reject. An empty table passes through as an empty table. Extra
columns are left out by the first stage. Rows that repeat an id each pass by their own text; of a class of near duplicates all rows
stay that have its least id, and a row of the same id with another text goes or stays with them. Texts of any length pass whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import decontamination, ngram_join, quality_rules, secret_scans, sentencepieces
from tidegrid.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the ledger is taken of the text and stays beside it, so that nothing has to be joined back
    led = quality_rules.ledger(docs.withColumn("row", F.struct(*COLUMNS)), "row", "text")
    return quality_rules.apply_policy(led).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_copies(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scans.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, MODEL)


STAGES = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("secret scans", redact_secrets), ("sentencepiece", tokenize),
]

#: Near duplicates, SimHash windows and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
