"""Sitemaps, robots files, search results, brand stores and generated inventories as tables."""

from __future__ import annotations

import datetime as dt
import gzip
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.errors import BadRequest, NotFound
from weftline.functions.vectors import let
from weftline.operators.store import patched
from weftline.plans.tables import current, replaced, written


def sitemap_urls(xml: Column | str) -> Column:
    """Page and child sitemap URLs of a sitemap, with or without a namespace; of malformed XML, none."""
    one = "array<struct<loc:string>>"
    read = F.from_xml(xml, f"url {one}, sitemap {one}", {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    locs = lambda found: F.filter(F.transform(F.coalesce(found, F.array()), lambda x: F.trim(x["loc"])), lambda x: x.isNotNull() & (x != ""))
    return let(read, lambda s: F.struct(locs(s["url"]).alias("urls"), locs(s["sitemap"]).alias("sitemaps")))


def page_urls(sitemaps: DataFrame, entry: str, children: int | None = 50, repeats: bool = False) -> DataFrame:
    """pos, page_url from a table (url, xml): those of the entry, or, if it is an index, of its first ``children`` sitemaps (None: all); first places only.

    With ``repeats`` a page comes at each place that names it. A sitemap that is named twice counts at its first place.
    """
    read = sitemaps.select("url", sitemap_urls("xml").alias("s")).select("url", "s.urls", "s.sitemaps")
    top = read.filter(F.col("url") == entry)
    kids = top.select(F.posexplode("sitemaps" if children is None else F.slice("sitemaps", 1, children)).alias("at", "kid")).groupBy("kid").agg(F.min("at").alias("at"))
    nested = kids.join(read, F.col("kid") == F.col("url")).select("at", F.posexplode("urls").alias("pos", "page_url"))
    own = top.filter(F.size("sitemaps") == 0).select(F.lit(0).alias("at"), F.posexplode("urls").alias("pos", "page_url"))
    pages = nested.union(own)
    return pages if repeats else pages.groupBy("page_url").agg(F.min(F.struct("at", "pos")).alias("first")).select("first.at", "first.pos", "page_url")


def walk_sitemaps(sitemaps: DataFrame, entry: str | DataFrame, limit: int | None = None) -> DataFrame:
    """page_url of all sitemaps of (url, xml) reachable from the entry; cycles end.

    Sitemaps are read level by level, in the order in which they are named, each once; any URL that ends in .xml is one. A
    ``limit`` keeps the pages that are found first. ``entry`` may be a table (site, url): then each site is walked by
    itself, ``limit`` counts for each, and site comes along, with ``place`` from 1 on in the order of the walk.
    """
    spark = sitemaps.sparkSession
    read = sitemaps.select("url", sitemap_urls("xml").alias("s")).select("url", F.posexplode(F.concat("s.urls", "s.sitemaps")).alias("pos", "loc"), (F.size("s.urls")).alias("own"))
    read = written(read.select("url", "pos", "loc", ((F.col("pos") >= F.col("own")) | F.col("loc").endswith(".xml")).alias("nested")), "sitemaps")
    entries = entry if isinstance(entry, DataFrame) else spark.createDataFrame([(None, entry)], "site string, url string")
    front = written(entries.select("site", "url", F.array().cast("array<int>").alias("key")).dropDuplicates(["site", "url"]), "front")
    seen, levels = front.select("site", "url"), [front]
    while not front.isEmpty():
        kids = front.join(read.filter("nested"), "url").groupBy("site", F.col("loc").alias("url")).agg(F.min(F.concat("key", F.array("pos"))).alias("key"))
        fresh = kids.alias("k").join(seen.alias("s"), F.col("k.site").eqNullSafe(F.col("s.site")) & (F.col("k.url") == F.col("s.url")), "left_anti")
        front = written(fresh.select("site", "url", "key"), "front")
        levels.append(front)
        seen = seen.union(front.select("site", "url"))
    walked = levels[0]
    for level in levels[1:]:
        walked = walked.union(level)
    at = F.struct(F.size("key").alias("level"), F.col("key"), F.col("pos"))
    pages = walked.join(read.filter("not nested"), "url").groupBy("site", F.col("loc").alias("page_url")).agg(F.min(at).alias("at"))
    if limit or isinstance(entry, DataFrame):
        pages = pages.withColumn("place", F.row_number().over(W.partitionBy("site").orderBy("at", "page_url")))
        pages = pages.filter(F.col("place") <= limit) if limit else pages
    return pages.select("site", "place", "page_url") if isinstance(entry, DataFrame) else pages.select("page_url")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """domain, place, sitemap from (domain, body): those the robots file names, then the two usual places, without repeats."""
    lines = F.filter(F.transform(F.split(F.coalesce("body", F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: F.lower(x).startswith("sitemap:"))
    named = F.filter(F.transform(lines, lambda x: F.trim(F.substring(x, 9, 2**31 - 1))), lambda x: x != "")
    usual = F.array(F.concat(F.lit("https://"), "domain", F.lit("/sitemap_index.xml")), F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")))
    return robots.select("domain", F.posexplode(F.array_distinct(F.concat(named, usual))).alias("place", "sitemap"))


def serp_items(raw: Column, engine: str, num: int = 50) -> Column:
    """A search engine's JSON as an array of (title, url, snippet, source), the first ``num``, which is clamped to 1..50."""
    if engine == "google":
        found = F.from_json(raw, "items array<struct<title:string,link:string,snippet:string>>")["items"]
        url = "link"
    else:
        found = F.from_json(raw, "webPages struct<value:array<struct<name:string,url:string,snippet:string>>>")["webPages"]["value"]
        url = "url"
    title = "title" if engine == "google" else "name"
    items = F.transform(F.coalesce(found, F.array()), lambda x: F.struct(x[title].alias("title"), x[url].alias("url"), x["snippet"].alias("snippet"), F.lit(engine).alias("source")))
    return F.slice(items, 1, clamped(num, 1, 50))


def clamped(value: int, low: int, high: int) -> int:
    return max(low, min(value, high))


BRANDS = "key string, name string, site_url string, audience string, categories array<string>, default_keywords array<string>"


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """The brands of a JSON store: {"brands": [...]}, a bare list, or lines as ``write_brands`` makes them; nothing if it is missing, empty or corrupt."""
    try:
        text = spark.read.text(current(spark, f"{path}.versions") or path, wholetext=True).select(F.trim("value").alias("t"))
        text.isEmpty()
    except Exception as e:  # Spark says so only when it lists the files
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], BRANDS)
    item = ", ".join(f.replace(" ", ":", 1) for f in BRANDS.split(", "))
    inner = F.from_json("t", f"brands array<struct<{item}>>")["brands"]
    lines = F.transform(F.split("t", "\n"), lambda x: F.from_json(x, f"struct<{item}>"))
    lines = F.filter(lines, lambda b: b["key"].isNotNull())
    listed = F.when(F.col("t").startswith("["), F.from_json("t", f"array<struct<{item}>>"))
    return text.select(F.explode(F.coalesce(listed, inner, lines, F.array())).alias("b")).filter("b is not null").select("b.*")


def write_brands(brands: DataFrame, path: str) -> None:
    """A store of brands, a JSON line each, that counts instead of what ``path`` holds; its versions are beside it. The new brands may be read from the old ones, and no failure leaves part of either."""
    replaced(brands, f"{path}.versions", "json")


def valid_key(key: str | None) -> str:
    """A brand's key, of letters, digits, dot, underscore and dash; another one: BadRequest."""
    if not key or not re.fullmatch("[A-Za-z0-9._-]+", key):
        raise BadRequest("a key is of letters, digits, dot, underscore or dash")
    return key


def with_brand(brands: DataFrame, **brand) -> DataFrame:
    """Brands with one created, or, where its key is there, updated in the values that are given."""
    valid_key(brand.get("key"))
    return patched(brands, brands.sparkSession.createDataFrame([brand], ", ".join(f for f in BRANDS.split(", ") if f.split()[0] in brand)), "key")


def updated_brand(brands: DataFrame, key: str, **values) -> DataFrame:
    """Brands with the given values of one that is there; none such: NotFound. None is no value."""
    if brands.filter(F.col("key") == valid_key(key)).isEmpty():
        raise NotFound(f"brand {key}")
    return with_brand(brands, key=key, **{k: v for k, v in values.items() if v is not None})


def without_brand(brands: DataFrame, key: str) -> DataFrame:
    """Brands without one that is there; none such: NotFound."""
    if brands.filter(F.col("key") == valid_key(key)).isEmpty():
        raise NotFound(f"brand {key}")
    return brands.filter(~F.col("key").eqNullSafe(F.lit(key)))


def brand_list(brands: DataFrame, q: str | None = None, category: str | None = None) -> DataFrame:
    """Brands of valid keys by a substring of key, name or audience and by a category, whatever the case; in order of key."""
    df = brands.filter(F.col("key").rlike("^[A-Za-z0-9._-]+$"))
    if q and q.strip():
        df = df.filter(F.lower(F.concat_ws(" ", "key", "name", "audience")).contains(q.strip().lower()))
    if category and category.strip():
        df = df.filter(F.exists("categories", lambda c: F.lower(c) == category.strip().lower()))
    return df.orderBy(F.lower("key"), "key")


def inventories(domains: DataFrame, limit: int, q: str | None = None) -> DataFrame:
    """Generated rows for each domain: domain, id, url, title, word_count, freshness. ``limit`` is clamped to 0..500."""
    n = clamped(limit, 0, 500)
    ids = F.sequence(F.lit(1), F.lit(n)) if n else F.array()
    rows = domains.select("domain", F.explode(ids.cast("array<long>")).alias("id"))
    i, kind = F.col("id"), "article" if q is None else "result"
    words, fresh = (150 + i % 75, 0.85 + (i % 17) * 0.009) if q is None else (200 + i % 90, 0.90 + (i % 13) * 0.007)
    title = F.lit("Article") if q is None else F.initcap(F.lit(q))
    return rows.select("domain", "id", F.concat(F.lit("https://"), "domain", F.lit(f"/{kind}-"), i).alias("url"), F.concat(title, F.lit(" "), i).alias("title"), words.cast("int").alias("word_count"), F.round(fresh, 6).alias("freshness"))


def inventory(spark: SparkSession, domain: str, limit: int, q: str | None = None) -> DataFrame:
    """Generated rows of one domain: id, url, title, word_count, freshness."""
    return inventories(spark.createDataFrame([(domain,)], "domain string"), limit, q).drop("domain")


def chunks(items: DataFrame, words: int = 200) -> DataFrame:
    """id, chunk_order, token_count, checksum and text of runs of ``words`` words."""
    w = F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda x: x != "")
    at = items.select("id", w.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int"))
    parts = F.transform(starts, lambda i: F.slice("w", i * words + 1, words))
    rows = at.select("id", F.posexplode(parts).alias("chunk_order", "p"))
    text = F.array_join("p", " ")
    return rows.select("id", "chunk_order", F.size("p").alias("token_count"), F.sha2(text, 256).alias("checksum"), text.alias("text"))


#: Fixed value: a page of more bytes is not read.
MAX_BYTES = 2_500_000


def acceptable(content_type: Column, length: Column, status: Column | None = None, most: int = MAX_BYTES) -> Column:
    """Whether a fetched page is to be read: HTML, not too long, no error."""
    ok = F.lower(F.coalesce(content_type, F.lit(""))).contains("html") & (F.coalesce(length, F.lit(0)) <= most)
    return ok if status is None else ok & (F.coalesce(status, F.lit(200)) < 400)


def _decoded(url: pd.Series, content_type: pd.Series, body: pd.Series) -> pd.Series:
    """Fetched bytes as text: those of .gz URLs and of gzip types are unpacked, if they can be; then UTF-8, with marks for what is none."""
    def one(u, kind, raw):
        if raw is None:
            return None
        if (u or "").lower().endswith(".gz") or "gzip" in (kind or ""):
            try:
                raw = gzip.decompress(raw)
            except (OSError, EOFError, zlib.error):
                pass
        return bytes(raw).decode("utf-8", "replace")

    return pd.Series([one(*x) for x in zip(url, content_type, body, strict=True)], dtype=object)


def decoded(url: Column, content_type: Column, body: Column) -> Column:
    return F.pandas_udf(_decoded, "string")(url, content_type, body)


def fetched(spark: SparkSession, path: str, most: int = MAX_BYTES, files: str = "*") -> DataFrame:
    """url (a file's path), modified, length, packed and html of the files under ``path`` whose names match ``files``: fetched bodies, plain or gzip.

    Files over ``most`` bytes are not opened, and texts over it are left out once unpacked. A file counts as packed if it begins as gzip does,
    whatever its name. One that cannot be unpacked to its end is read as it is, with marks for what is no UTF-8. Spark skips empty files.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", files).load(path).filter(F.col("length") <= most)
    packed = F.coalesce(F.hex(F.substring("content", 1, 2)) == "1F8B", F.lit(False))
    kind = F.when(packed, "application/gzip").otherwise("text/html")
    rows = read.select(F.col("path").alias("url"), F.col("modificationTime").alias("modified"), "length", packed.alias("packed"), decoded(F.lit(""), kind, F.col("content")).alias("html"))
    return rows.filter(F.octet_length("html") <= most)


def _zipped(body: pd.Series) -> pd.Series:
    return body.map(lambda b: None if b is None else gzip.compress(b, 1, mtime=0))


def zipped(body: Column) -> Column:
    return F.pandas_udf(_zipped, "binary")(body)


def search_rows(rows: DataFrame, dimensions: list[str], row_limit: int = 25_000, start_row: int = 0) -> DataFrame:
    """Clicks and impressions by dimensions, most clicks first, from ``start_row`` on, ``row_limit`` at most."""
    sums = rows.groupBy(*dimensions).agg(F.sum("clicks").cast("long").alias("clicks"), F.sum("impressions").cast("long").alias("impressions"))
    return sums.orderBy(F.col("clicks").desc(), *dimensions).offset(start_row).limit(row_limit)


def ingest_acknowledgement(spark: SparkSession, found: int, limit: int | None = None) -> DataFrame:
    """The answer to an ingest request: accepted, message, estimated_items, capped by a limit that is given."""
    n = min(found, limit) if limit else found
    return spark.range(1).select(F.lit(True).alias("accepted"), F.lit(f"Ingest complete: {n} items processed").alias("message"), F.lit(n).cast("long").alias("estimated_items"))


def sitemap_sample(urls: DataFrame, limit: int = 20) -> DataFrame:
    """The first urls of a sitemap in order, ``limit`` at most and never fewer than none."""
    return urls.select("url").orderBy("url").limit(max(0, limit))


def export_csv(rows: DataFrame, folder: str, domain: str, at: dt.datetime) -> str:
    """Writes rows as CSV with a header to export_{domain}_{stamp} in a folder, and says where."""
    path = f"{folder}/export_{domain.replace('/', '-')}_{at:%Y%m%d_%H%M%S}.csv"
    rows.write.option("header", True).csv(path)
    return path


def export_jsonl(rows: DataFrame, path: str) -> None:
    """Writes rows as JSON lines; null columns stay in, so that each line has all fields."""
    rows.write.option("ignoreNullFields", False).json(path)
