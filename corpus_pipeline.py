"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, jaccard, language, mixing, pii
from quantloom.llm.common import table
from quantloom.llm.queries import weighted
from quantloom.session import ship, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose trigrams are known to its best language in less than this share is in none of them.
LEAST_HIT_RATE = 0.25
#: Near duplicates: five words, four fifths.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language; null and empty texts, texts without a letter and texts in no known language go.

    Repeated rows are judged alike and stay; an empty table stays empty (nothing is learned then, and everything is unknown); other columns go.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = language.predict(docs, language.learn(docs), keep_text=True)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("hit_rate") >= LEAST_HIT_RATE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of linked documents.

    Repeated rows and rows of one text are one group; null texts and texts without words link with nothing and stay; ties of ids are
    broken by a digest of the text.  An empty table stays empty; other columns go.
    """
    ship(spark)
    return jaccard.distinct_documents(docs.select(*COLUMNS), SHINGLE_WORDS, SHINGLE_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts hold none and stay; repeated rows share their fate.  Items without words, an empty benchmark and an empty table drop nothing; other columns go.
    """
    docs = docs.select(*COLUMNS)
    hit = decontaminate.hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(
        F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"))
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (decontaminate.text_key(F.col("text")) == F.col("_t")), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every confirmed span replaced by its kind; ``n_chars`` follows where a text changes.

    Null and empty texts and repeated rows pass through; an empty table stays empty; other columns go.
    """
    found = docs.select(*COLUMNS, pii.find(F.col("text")).alias("_spans"))
    clean = found.withColumn("text", pii.redact(F.col("text"), F.col("_spans")))
    return clean.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document.

    Null texts and null sources count as in ``mixing``; repeated rows are mixed one by one; an empty table stays empty; other columns go.
    """
    return mixing.mix(weighted(docs, table(spark, sf_dir, "labels")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Language identification is a trained model and redaction follows from positions; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
