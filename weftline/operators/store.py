"""Writes as functions from tables to tables: insert if absent, upsert, partial update, delete, update what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import BadRequest
from weftline.functions import vectors


def one_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: that of the largest ``order``. A partial maximum."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max(F.struct(order.alias("__o"), *rest)).alias("m"))
    return top.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest])


def insert_new(target: DataFrame, source: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``target`` and those of ``source`` whose key it lacks, one per key."""
    return target.unionByName(one_per_key(source, keys, order).join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], values: list[str], now: Column, order: Column) -> DataFrame:
    """``target`` with the values of ``source`` where keys agree, and its other rows; '' is null; created_at stays."""
    s = one_per_key(source.select(*keys, *values), keys, order).select(*keys, *[F.nullif(F.col(v), F.lit("")).alias(f"__{v}") for v in values], F.lit(True).alias("__new"))
    both = target.join(s, keys, "full")
    pick = lambda v: F.when(F.col("__new"), F.col(f"__{v}")).otherwise(F.col(v)).alias(v)
    return both.select(*keys, *[pick(v) for v in values], F.coalesce("created_at", now).alias("created_at"), F.when(F.col("__new"), now).otherwise(F.col("updated_at")).alias("updated_at"))


def patched(target: DataFrame, source: DataFrame, key: str, insert: bool = True) -> DataFrame:
    """``target`` with the values of ``source`` that are not null; with ``insert`` also the rows whose key it lacks. ``source`` has a row per key."""
    values = [c for c in target.columns if c != key]
    new = source.select(key, *[(F.col(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType)).alias(f"__{c}") for c in values])
    both = target.join(new, key, "full" if insert else "left")
    return both.select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in values])


def deleted(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``target`` without the rows whose key is in ``keys``."""
    return target.join(keys.select(key), key, "left_anti")


def changed(target: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """key, old and new of the rows whose value ``source`` changes, nulls compared as values."""
    both = target.select(key, F.col(value).alias("old")).join(source.select(key, F.col(value).alias("new")), key)
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def assigned(target: DataFrame, source: DataFrame, key: str, value: str) -> DataFrame:
    """``target`` with the value that ``source`` (a row per key) has for its key, null too, and ``changed``: whether it is another one. Other rows stay."""
    new = source.select(F.col(key).alias("__key"), F.col(value).alias("__new"), F.lit(True).alias("__has"))
    both = target.join(new, F.col(key) == F.col("__key"), "left")
    is_new = F.coalesce(F.col("__has") & ~F.col(value).eqNullSafe(F.col("__new")), F.lit(False))
    return both.withColumn("changed", is_new).withColumn(value, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(value))).drop("__key", "__new", "__has")


def cleared(target: DataFrame, value: str, where: Column | None = None) -> DataFrame:
    """``target`` with null for a value in all rows, or those of ``where``, and ``changed``."""
    on = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    kind = target.schema[value].dataType
    return target.withColumn("changed", on & F.col(value).isNotNull()).withColumn(value, F.when(~on, F.col(value)).otherwise(F.lit(None).cast(kind)))


def reembedded(items: DataFrame, scope: str = "missing", url: str | None = None, domain: str | None = None, dim: int = 64) -> DataFrame:
    """Items with new character-hash embeddings of "title url" in the scope: missing (null or empty), all, or single (one url). ``updated`` says which.

    Rows in the scope and the others are read separately, so that only the former go through a Python worker. Another scope, or single without a url: BadRequest.
    """
    if scope not in ("missing", "all", "single") or scope == "single" and not url:
        raise BadRequest("scope must be missing, all, or single with a url")
    on = {"missing": F.col("embedding").isNull() | (F.size("embedding") == 0), "all": F.lit(True), "single": F.col("url") == url}[scope]
    on = on & (F.col("domain") == domain) if domain else on
    rows = items.withColumn("updated", F.coalesce(on, F.lit(False)))
    told = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("url", F.lit("")))
    new = rows.filter("updated").withColumn("embedding", vectors.char_hash(told, dim))
    return new.unionByName(rows.filter("not updated").withColumn("embedding", F.col("embedding").cast(vectors.VECTOR)))


def ingested_urls(items: DataFrame, urls: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Items (site_id, url, created_at, updated_at) with the new ones of (site_id, url), and per site total, inserted, and skipped of all urls found."""
    have = items.select("site_id", "url").distinct().withColumn("have", F.lit(True))
    found = urls.groupBy("site_id", "url").agg(F.count(F.lit(1)).alias("n")).join(have, ["site_id", "url"], "left")
    told = found.groupBy("site_id").agg(F.sum("n").alias("total"), F.count_if(F.col("have").isNull()).alias("inserted"))
    new = found.filter("have is null").select("site_id", "url", now.alias("created_at"), now.alias("updated_at"))
    return items.unionByName(new, allowMissingColumns=True), told.withColumn("skipped", F.col("total") - F.col("inserted"))


def retrieval_upserted(index: DataFrame | None, docs: DataFrame, dim: int = 64) -> DataFrame:
    """A retrieval index (id, url, title, text, embedding) with ``docs`` (id, url, title, text) in it, instead of the rows of their ids; one row per id."""
    new = one_per_key(docs.select("id", "url", "title", "text"), ["id"], F.col("url"))
    new = new.withColumn("embedding", vectors.char_hash(F.col("text"), dim))
    return new if index is None else deleted(index, new, "id").unionByName(new)
