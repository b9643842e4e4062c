"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import gram_features, scored, trained
from .shared import null_safe_text

#: The most labelled rows from which a model is fitted: those of the smallest hashed doc_id, then text.
TRAIN_ROWS = 12_000


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS):
    """A model of the labels in rows that are not held out; a label that is neither 0 nor 1 is none, and of several for a doc_id the largest counts.

    The choice of labels and then of labelled documents are both the ``rows`` smallest by hash, so neither grows with the tables.
    """
    few = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", null_safe_text().alias("text")).join(F.broadcast(few), "doc_id")
    return trained(own.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows), gram_features)


def toxicity(docs: DataFrame, model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for each row, by its whole text alone.

    Nulls: a null text is empty; a null doc_id is kept and not held out. An empty text, and a text with no word that the
    model knows, has the bias alone as its score. Repeated rows come back as often. Ties cannot matter: a score depends
    on the text only. Without any labels the score is 0.5 throughout. An empty table gives no rows. Other columns are ignored.
    """
    score = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text")), model, gram_features)
    return score.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def toxic_flags(docs: DataFrame, model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with score and predicted, by its string column ``text``; all columns are kept, and of clashing names the new ones stay.

    Nulls: a null text is scored as an empty one and stays null. Repeated rows come back as often. An empty table gives no rows.
    """
    back = scored(docs.drop("score", "predicted"), model, gram_features, text=text, keep_text=True)
    return back.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, with a model of the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
