"""URLs as column expressions."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def path(url: Column) -> Column:
    """The path without its last slashes; / if there is none or the URL cannot be parsed."""
    p = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    cut = F.regexp_replace(p, "/+$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def is_homepage(url: Column) -> Column:
    """No path but /, no query, no fragment."""
    part = lambda what: F.coalesce(F.try_parse_url(url, F.lit(what)), F.lit(""))
    return part("PATH").isin("", "/") & (part("QUERY") == "") & (part("REF") == "")


def matches(text: Column, pattern: str | None) -> Column:
    """Whether a pattern is found; one that is missing, or invalid for Python or for Java, is found nowhere."""
    if not pattern:
        return F.lit(False)
    try:
        re.compile(pattern)
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern)
    except (re.error, Py4JJavaError, IllegalArgumentException):
        return F.lit(False)
    return text.rlike(pattern)


def site_url(url: Column) -> Column:
    """With a scheme (https) and a last slash; null and blank stay null."""
    u = F.nullif(F.trim(url), F.lit(""))
    u = F.when(u.rlike("^(https?://|sc-domain:)"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.when(u.endswith("/") | u.startswith("sc-domain:"), u).otherwise(F.concat(u, F.lit("/")))


def absolute(href: Column, base: Column) -> Column:
    """A link as an absolute URL: paths from the root are resolved, others stay."""
    return F.when(href.startswith("/"), F.concat(F.regexp_extract(base, "^(https?://[^/]+)", 1), href)).otherwise(href)
