"""Improvement recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quick_wins(items: DataFrame) -> DataFrame:
    """Items whose title has over 60 characters: id, domain, flag, score, rationale."""
    n = F.length("title")
    why = F.to_json(F.struct(F.lit("long_title").alias("reason"), n.alias("title_length")))
    return items.filter(n > 60).select("id", "domain", F.lit("quick_win").alias("flag"), F.round(0.7 + F.least(F.lit(0.2), (n - 60) / 100), 6).alias("score"), why.alias("rationale"))


def at_risk(items: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Items that were updated more than ``days`` days before ``as_of``."""
    stale = F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    why = F.to_json(F.struct(F.lit("stale").alias("reason"), F.lit(days).alias("days")))
    return items.filter(stale).select("id", "domain", F.lit("at_risk").alias("flag"), F.lit(0.85).alias("score"), why.alias("rationale"))


def emerging(items: DataFrame) -> DataFrame:
    """One recommendation per domain that is about no item."""
    return items.select("domain").distinct().select(F.lit(None).cast("long").alias("id"), "domain", F.lit("emerging_topic").alias("flag"), F.lit(0.65).alias("score"), F.to_json(F.struct(F.lit("seed").alias("reason"))).alias("rationale"))


def candidates(items: DataFrame, as_of: str, limit: int = 200) -> DataFrame:
    """The three kinds together; of the first two the ``limit // 2`` smallest ids."""
    return at_risk(items, as_of).orderBy("id").limit(limit // 2).unionByName(quick_wins(items).orderBy("id").limit(limit // 2)).unionByName(emerging(items))


def ranked(recs: DataFrame, flag: str, limit: int = 50) -> DataFrame:
    return recs.filter(F.col("flag") == flag).orderBy(F.col("score").desc_nulls_last(), "id").limit(limit)


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the scores of ``new`` where these are strictly higher (null counts as 0), and new rows; keys may be null. With ``outcome``."""
    n = new.groupBy("id", "domain", "flag").agg(F.max("score").alias("new"))
    o = old.select(F.col("id").alias("oid"), F.col("domain").alias("odomain"), F.col("flag").alias("oflag"), F.col("score").alias("old"), F.lit(True).alias("was"))
    both = o.join(n, F.col("oid").eqNullSafe(F.col("id")) & (F.col("odomain") == F.col("domain")) & (F.col("oflag") == F.col("flag")), "full")
    better = F.col("new") > F.coalesce("old", F.lit(0.0))
    return both.select(
        F.coalesce("id", "oid").alias("id"), F.coalesce("domain", "odomain").alias("domain"), F.coalesce("flag", "oflag").alias("flag"),
        F.when(F.col("was").isNull() | better, F.col("new")).otherwise(F.col("old")).alias("score"),
        F.when(F.col("was").isNull(), "inserted").when(better, "updated").otherwise("kept").alias("outcome"),
    )
