"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents.  run() writes every stage's result to the shared folder as Parquet
and reads it back as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, jaccard_join, language_id, secrets, sentencepiece_fst
from cairn.llm.common import read, stage

#: Least posterior of the predicted language.
LEAST_SCORE = 0.5
#: Up to so many doc_ids to drop are sent to the tasks; more are joined with a shuffle.
BROADCAST_IDS = 500_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: not `und`, and the prediction likelier than not.

    The model learns from the labelled documents of the input; lang stays as it came.
    """
    model = language_id.train(docs.select("text", "lang"))
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return language_id.classify(docs, model).where(known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked ones, the least doc_id, and one of equal rows of it.

    Documents without words and rows without doc_id link with nothing and stay.
    """
    found = stage(jaccard_join.jaccard_join(docs.select("doc_id", "text")).select("doc_id", "component_id"), "found")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.take(1):
        kept = kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontaminate.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mark; n_chars follows the text."""
    dictionary, forest, _ = secrets.learn(docs.select("doc_id", "text"))
    clean = secrets.redact(docs, dictionary, forest)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of each text, their number and checksum, and whether they decode to the text again."""
    model = sentencepiece_fst.load(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_fst.encode_and_decode(docs, model, with_text=False)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express the stages' models; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
