"""The engine's tables over the given Parquet tables, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BASE_DAY = "2023-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, domain: a row per source, numbered in order; there are few, and only their names are sorted."""
    own = table(spark, sf_dir, "documents").select(F.col("source").alias("domain")).distinct()
    return own.select(F.dense_rank().over(W.orderBy("domain")).cast("long").alias("id"), F.col("domain").alias("name"), "domain")


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as content: id, domain, url, title (the first line, 120 characters at most: a rule of these tables), content, updated_at."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("domain"), F.format_string("https://%s.example/%s/%d", "source", "lang", "doc_id").alias("url"),
        F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"), F.col("text").alias("content"),
        (F.lit(BASE_DAY).cast("timestamp") + F.make_dt_interval((F.col("doc_id") % 400).cast("int"))).alias("updated_at"),
    )


def embedded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``content_items`` with embedding and cluster_id, where there are any."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster_id"))
    return content_items(spark, sf_dir).join(e, "id", "left")


ITEMS_SQL = f"""items AS (
  SELECT d.doc_id AS id, source AS domain, 'https://' || source || '.example/' || lang || '/' || doc_id AS url,
    substr(split_part(text, chr(10), 1), 1, 120) AS title, text AS content,
    TIMESTAMP '{BASE_DAY}' + to_days((doc_id % 400)::INTEGER) AS updated_at, e.embedding, e.label AS cluster_id
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as analytics snapshots: id, site_id, source, captured_at, revenue."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("site_id"), F.col("event_type").alias("source"), F.col("ts").alias("captured_at"), F.col("value").alias("revenue"))


SNAPSHOTS_SQL = "snapshots AS (SELECT event_id AS id, user_id % 5 AS site_id, event_type AS source, ts AS captured_at, value AS revenue FROM events)"


def linked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as pages of one site: id, url, embedding, cluster_id; each 97th has the homepage's URL."""
    e = table(spark, sf_dir, "embeddings")
    url = F.when(F.col("vec_id") % 97 == 0, "https://site.example/").otherwise(F.format_string("https://site.example/c%d/p%d/", "label", "vec_id"))
    return e.select(F.col("vec_id").alias("id"), url.alias("url"), "embedding", F.col("label").alias("cluster_id"))


LINKED_SQL = """linked AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 97 = 0 THEN 'https://site.example/' ELSE 'https://site.example/c' || label || '/p' || vec_id || '/' END AS url,
    CASE WHEN vec_id % 97 = 0 THEN '/' ELSE '/c' || label || '/p' || vec_id END AS path, vec_id % 97 = 0 AS home, embedding, label AS cluster_id,
    list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u
  FROM embeddings)"""
