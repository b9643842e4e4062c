"""A training corpus from documents: toxic ones go, near-duplicates go, leaks of the benchmark go, secrets are struck out, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a table that the next one takes as its documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontamination import decontaminate
from weftline.llm.neardup import near_duplicates
from weftline.llm.packing import pack_documents
from weftline.llm.secrets import redact
from weftline.llm.toxicity import fit, toxic_flags
from weftline.plans.tables import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents' columns and ``row``, which tells apart rows that share a doc_id: a row's file and place in it, or a number in a table that is written for it."""
    try:
        return docs.select(*COLUMNS, F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("row"))
    except AnalysisException:  # not a scan of files
        return written(docs.select(*COLUMNS, F.monotonically_increasing_id().cast("string").alias("row")), "documents")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels does not call toxic. The model is fitted on the rows of these documents that are labelled and not held out.

    Each row is judged by its own text, a null one as an empty one, and stays as it is; repeated rows and ids stay or go
    alike. Without labels nothing goes. An empty table gives no rows.
    """
    return toxic_flags(docs.select(*COLUMNS), fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).filter("predicted = 0").select(*COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates over five-word shingles at a similarity of 0.8: that of the smallest doc_id.

    Of rows that repeat this doc_id in a group, one stays; so does one of a group without ids. Different groups each keep
    a document, whatever their ids. A document without words is in no group and stays. An empty table gives no rows.
    """
    rows = _numbered(docs)
    found = near_duplicates(rows, words=5, percent=80, keep=("row",), group="group").filter("group is not null")
    stays = found.filter("kept").groupBy("group").agg(F.min("row").alias("row"))
    goes = written(found.join(stays, "row", "left_anti").select("row"), "near-duplicates")
    return rows.join(goes, "row", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark; other rows with the same doc_id, or with none, are judged by themselves.

    A null or empty text holds nothing. Without items nothing goes. An empty table gives no rows.
    """
    rows = _numbered(docs)
    leaks = written(decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row="row").select("row").distinct(), "leaks")
    return rows.join(leaks, "row", "left_anti").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars as it is then.

    A null text stays null, with a null n_chars. Repeated rows and ids are treated alike. An empty table gives no rows.
    """
    return redact(docs.select(*COLUMNS), beside=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, with their ids.

    A null or empty text has its end id alone; a null doc_id is kept; repeated rows are packed once each. An empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", neardup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the model nor the sketches; tests hold the stages against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again, and the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
