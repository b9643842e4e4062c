"""Prompts as column expressions, in wording of our own, and their fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "article": "Write an article on {topic} for {audience}. Points to make:\n{points}\nUse these words: {keywords}.",
    "social": "Write a short post on {topic} that {audience} would share.\n{points}",
    "newsletter": "Write a newsletter issue on {topic} for {audience}:\n{points}",
    "seo": "Suggest a title and a description for a page on {topic}. Search words: {keywords}.",
}


def bullets(points: Column) -> Column:
    return F.array_join(F.transform(F.filter(points, lambda p: F.trim(p) != ""), lambda p: F.concat(F.lit("- "), F.trim(p))), "\n")


def render(kind: str, topic: Column, audience: Column, points: Column, keywords: Column) -> Column:
    out = F.lit(TEMPLATES[kind])
    for name, value in (("topic", topic), ("audience", audience), ("points", bullets(points)), ("keywords", F.array_join(keywords, ", "))):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)
