"""Sites: resolving one, what belongs to it, what is purged from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import BadRequest, NotFound


def resolve(sites: DataFrame, site_id: int | None = None, domain: str | None = None) -> int:
    """The id of a site by its id or else its domain. Neither given: BadRequest; none such: NotFound."""
    if not site_id and not domain:
        raise BadRequest("give a site_id or a domain")
    found = sites.filter(F.col("id") == site_id) if site_id else sites.filter(F.col("domain") == domain)
    row = found.select("id").orderBy("id").first()
    if row is None:
        raise NotFound(f"site {site_id or domain}")
    return row["id"]


def holdings(sites: DataFrame, items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """id, domain, items, snapshots of every site. Both sides are counted before they meet, so neither multiplies the other."""
    own = items.groupBy("domain").agg(F.count(F.lit(1)).alias("items"))
    snaps = snapshots.groupBy("site_id").agg(F.count(F.lit(1)).alias("snapshots"))
    both = sites.join(own, "domain", "left").join(snaps, F.col("id") == F.col("site_id"), "left")
    return both.select("id", "domain", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("snapshots", F.lit(0)).alias("snapshots"))


def purge(items: DataFrame, is_post: Column, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """The items that stay, and per domain how many were found to be no posts and deleted. A dry run deletes none. What cannot be told counts as a post."""
    post = F.coalesce(is_post, F.lit(True))
    found = F.count_if(~post)
    told = items.groupBy("domain").agg(found.alias("found"), (F.lit(0).cast("long") if dry_run else found).alias("deleted"))
    return items if dry_run else items.filter(post), told


def serialised(items: DataFrame) -> DataFrame:
    """Items as they are handed out: no null schema types, times as ISO 8601 text. Columns that the table lacks are null."""
    have = set(items.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    iso = lambda c: F.date_format(col(c, "timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    types = F.coalesce(col("schema_types", "array<string>"), F.array().cast("array<string>")).alias("schema_types")
    return items.select("id", "url", "title", col("word_count", "int").alias("word_count"), types, col("freshness_score", "double").alias("freshness_score"), iso("lastmod"), iso("date_published"), iso("date_modified"))


def pending(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items whose title or content is null or empty, newest first."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    found = items.filter(empty("title") | empty("content"))
    return found.orderBy(F.col("id").desc()).limit(limit) if limit is not None else found
