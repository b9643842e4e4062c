"""Traffic snapshots: the latest by source, summaries, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import BadRequest
from weftline.functions import dates


def latest_by_source(snaps: DataFrame) -> DataFrame:
    """The newest snapshot of each site and source; ties to the larger id. A partial maximum, so a hot source is no hot task."""
    top = snaps.groupBy("site_id", "source").agg(F.max(F.struct("captured_at", "id", "revenue")).alias("m"))
    return top.select("site_id", "source", "m.captured_at", "m.id", "m.revenue")


def summary(snaps: DataFrame) -> DataFrame:
    """Per site: snapshots, sources in order, the newest time."""
    return snaps.groupBy("site_id").agg(F.count(F.lit(1)).alias("snapshots"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.max("captured_at").alias("latest"))


def recent(snaps: DataFrame, site_id: int, source: str, limit: int = 50) -> DataFrame:
    return snaps.filter((F.col("site_id") == site_id) & (F.col("source") == source)).orderBy(F.col("captured_at").desc(), F.col("id").desc()).limit(limit)


def search_totals(rows: DataFrame, by: str) -> DataFrame:
    """clicks, impressions, ctr (0 without impressions) and position, the plain mean of those that are not null."""
    t = rows.groupBy(by).agg(F.sum("clicks").cast("long").alias("clicks"), F.sum("impressions").cast("long").alias("impressions"), F.round(F.avg("position"), 6).alias("position"))
    return t.withColumn("ctr", F.when(F.col("impressions") > 0, F.round(F.col("clicks") / F.col("impressions"), 6)).otherwise(F.lit(0.0)))


def traffic_totals(rows: DataFrame, by: str) -> DataFrame:
    """sessions, conversions, revenue (2 decimals) and rows."""
    return rows.groupBy(by).agg(F.sum("sessions").cast("long").alias("sessions"), F.sum("conversions").cast("long").alias("conversions"), F.round(F.sum("revenue"), 2).alias("revenue"), F.count(F.lit(1)).alias("rows"))


#: What a snapshot holds where no live source is asked.
STUBS = {
    "gsc": {"clicks": 123, "impressions": 4567, "ctr": round(123 / 4567, 4), "average_position": 18.7},
    "ga4": {"organic_sessions": 789, "conversions": 17, "revenue": 1234.56},
}
SNAPSHOT = "site_id long, source string, captured_at timestamp, period_start timestamp, period_end timestamp, clicks int, impressions int, ctr double, average_position double, organic_sessions int, conversions int, revenue double, notes map<string,string>"


def merged_notes(notes: Column, more: Column) -> Column:
    """Two maps as one; where both have a key, ``more`` has its value. Null is empty."""
    empty = F.create_map().cast("map<string,string>")
    notes, more = F.coalesce(notes, empty), F.coalesce(more, empty)
    return F.map_concat(F.map_filter(notes, lambda k, _: ~F.map_contains_key(more, k)), more)


def stub_snapshot(spark: SparkSession, site_id: int, source: str, now: str, start: str | None = None, end: str | None = None, notes: dict | None = None) -> DataFrame:
    """A snapshot of a source's fixed values, of the seven days before ``now`` unless said otherwise. An unknown source: BadRequest."""
    if source not in STUBS:
        raise BadRequest(f"source {source}")
    at = lambda x: F.lit(x).cast("timestamp")
    first, last = dates.default_range(at(start), at(end), at(now))
    have = {"site_id": F.lit(site_id), "source": F.lit(source), "captured_at": at(now), "period_start": first, "period_end": last} | {k: F.lit(v) for k, v in STUBS[source].items()}
    given = notes or {"stub": "true", "via": f"ingest_{source}"}
    have["notes"] = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
    return spark.range(1).select(*[have.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in (f.split(" ", 1) for f in SNAPSHOT.split(", "))])


def ingested(snaps: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots with the new ones whose (site_id, captured_at, source) is not there; one of each."""
    keys = ["site_id", "captured_at", "source"]
    fresh = new.dropDuplicates(keys).join(snaps.select(*keys), keys, "left_anti")
    return snaps.unionByName(fresh, allowMissingColumns=True)
