"""Authority signals of pages and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.functions.vectors import let

#: First words that begin no entity.
ENTITY_STOPS = ("The", "A", "An", "And", "Or", "In", "On", "Of", "For", "With", "By")
#: The patterns of entities, bylines and citations. What repeats without bound is possessive, as Java would need stack for each repetition.
ENTITY = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b"
BYLINE = r"\bBy\s+([A-Z][\w.-]++(?:\s++[A-Z][\w.-]++)*+)"
CITATION = r"\[(?:\d{1,3}|fn:\w+)\]"
JSONLD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
META = r"""(?is)<meta\b(?:[^>"']|"[^"]*"|'[^']*')*+>"""
#: The meta tags that name authors, and where their names stand, in this order.
META_AUTHORS = ("author", "article:author", "twitter:creator")
META_KEYS = ("name", "property")


def is_html(raw: Column) -> Column:
    low = F.lower(raw)
    return raw.contains("</") | low.contains("<html") | low.contains("<body")


def first_by_case(found: Column, most: int = 2**31 - 1) -> Column:
    """The entries whose lower case no entry before has, ``most`` at most."""
    pick = lambda found, lower: F.transform(F.slice(F.array_distinct(lower), 1, most), lambda k: F.element_at(found, F.array_position(lower, k).cast("int")))
    return let(found, lambda found: let(F.transform(found, F.lower), lambda lower: pick(found, lower)))


def entities(text: Column, most: int = 200) -> Column:
    """Runs of one to four capitalised words that do not begin with a stop, without repeats, ``most`` at most."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)), lambda e: ~F.regexp_extract(e, "^[A-Za-z]+", 0).isin(*ENTITY_STOPS))
    return first_by_case(runs, most)


def jsonld(html: Column) -> Column:
    """The JSON-LD blocks of a page as variants: null where a block is no JSON, an empty object where it is empty."""
    blocks = F.regexp_extract_all(html, F.lit(JSONLD), F.lit(1))
    return F.transform(blocks, lambda b: F.try_parse_json(F.when(b == "", "{}").otherwise(b)))


def _listed(v: Column) -> Column:
    """A variant's entries if it is a list, else itself."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))


def _authors(block: Column) -> Column:
    """Names of the authors of a block, of the objects of a list of blocks, and of lists of authors. A name counts if it is text."""
    author = lambda b: F.try_variant_get(b, "$.author", "variant")
    name = lambda a: F.try_variant_get(a, "$.name", "variant")
    people = F.flatten(F.transform(F.filter(F.transform(_listed(block), author), lambda a: a.isNotNull()), _listed))
    names = F.filter(F.transform(people, name), lambda n: n.isNotNull() & (F.schema_of_variant(n) == "STRING"))
    return F.transform(names, lambda n: F.try_variant_get(n, "$", "string"))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, in either quotes or none; empty where it is missing."""
    one = lambda i: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", i)
    return F.concat(one(1), one(2), one(3))


def bylines(text: Column, html: Column) -> Column:
    """Authors by JSON-LD names, meta tags and visible "By Name", without repeats."""
    names = F.flatten(F.transform(F.filter(jsonld(html), lambda v: v.isNotNull()), _authors))
    tags = F.regexp_extract_all(html, F.lit(META), F.lit(0))
    told = lambda key, value: F.transform(F.filter(tags, lambda t: _attribute(t, key) == value), lambda t: _attribute(t, "content"))
    meta = [told(key, value) for key in META_KEYS for value in META_AUTHORS]
    seen = F.regexp_extract_all(text, F.lit(BYLINE), F.lit(1))
    return first_by_case(F.filter(F.transform(F.concat(names, *meta, seen), lambda a: F.trim(a)), lambda a: a != ""))


def html_text(html: Column) -> Column:
    """Text of HTML by patterns: scripts and styles out, tags to spaces."""
    return tx.clean(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " "), r"<[^>]+>", " "))


def signals(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with entity_coverage (3 decimals), citations, external_links, schema_present and bylines of its text or HTML column ``raw``."""
    r = F.coalesce(F.col(raw), F.lit(""))
    d = df.withColumn("__h", F.when(is_html(r), r).otherwise(F.lit(""))).withColumn("__t", F.when(is_html(r), html_text(r)).otherwise(r))
    words = F.greatest(tx.word_count(F.col("__t")), F.lit(1))
    coverage = F.least(F.size(entities(F.col("__t"))) / F.greatest(words / 300, F.lit(1e-6)) / 12, F.lit(1.0))
    links = external_links(F.col("__h"))["count"]
    schema = F.exists(jsonld(F.col("__h")), lambda v: v.isNotNull())
    return d.select(
        *df.columns, F.round(coverage, 3).alias("entity_coverage"),
        (F.regexp_count("__t", F.lit(CITATION)) + F.regexp_count("__t", F.lit(r"https?://\S+"))).alias("citations"),
        links.alias("external_links"), schema.cast("int").alias("schema_present"), F.size(bylines(F.col("__t"), F.col("__h"))).alias("bylines"),
    )


def external_links(html: Column, base_url: Column | None = None) -> Column:
    """(count, domains) of the absolute links of anchors, the domains in order without repeats; with ``base_url``, without links to its own host."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href=["']\s*(https?://[^"'\s]+)"""), F.lit(1))
    host = lambda u: F.lower(F.regexp_extract(u, r"^(?i:https?)://([^/?#]*)", 1))
    if base_url is not None:
        found = F.filter(found, lambda u: ~F.coalesce((host(u) == host(base_url)) & (host(base_url) != ""), F.lit(False)))
    return F.struct(F.size(found).alias("count"), F.array_sort(F.array_distinct(F.transform(found, host))).alias("domains"))


def score_batch(urls: DataFrame) -> DataFrame:
    """Signals of a stand-in page for each url, as nothing is fetched."""
    page = F.concat(F.lit("<html><body><p>Stub fetch for "), F.coalesce("url", F.lit("")), F.lit("</p></body></html>"))
    return signals(urls.select("url", page.alias("html")), "html").drop("html")


def scored_items(items: DataFrame, raw: str, at: Column) -> DataFrame:
    """Items with the signals of a text or HTML column under the names of the items' own columns, and when they were scored."""
    named = {"entity_coverage": "authority_entity_score", "citations": "authority_citation_count", "external_links": "authority_external_links", "bylines": "authority_author_bylines"}
    done = signals(items.drop(*named.values(), "authority_schema_present", "authority_last_scored_at"), raw).withColumnsRenamed(named)
    return done.withColumn("authority_schema_present", F.col("schema_present") == 1).drop("schema_present").withColumn("authority_last_scored_at", at)
