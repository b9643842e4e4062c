"""Text as column expressions: cleaning, tokens, n-grams, keyword counts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that label no topic. Site and brand names are added with ``stopwords(extra)``.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "than", "that", "this", "to", "of", "on", "in", "for", "with", "by", "as", "at", "be", "is", "are", "was", "were", "it", "its", "from", "into", "your", "you", "we", "our", "us",
    "com", "www", "http", "https",
    "guide", "tips", "playbook", "best", "practices", "strategy", "strategies", "framework", "intro", "introduction",
)
#: Possessive: a repeated group would otherwise need stack for each repetition.
TOKEN = r"[A-Za-z0-9]++(?:['-][A-Za-z0-9]++)*+"
#: Runs of two letters, digits or underscores of any script and more.
WORD = r"[\p{L}\p{N}_]{2,}"


def stopwords(extra: str | None = None) -> list[str]:
    """The fixed list and those of ``extra``, separated by commas or white space."""
    return sorted({*STOPWORDS, *(w.lower() for w in re.split(r"[\s,]+", extra or "") if w)})


def clean(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def tokens(text: Column, stops: list[str] | None = None) -> Column:
    """Lower-case tokens of two characters and more that are no stopwords; an empty list of stopwords is the fixed one."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stops or list(STOPWORDS)))


def ngrams(toks: Column, most: int = 2) -> Column:
    """All n-grams of 1 to ``most`` tokens, shorter ones first, in order."""
    def of(n: int) -> Column:
        starts = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(toks, i, n), " "))

    return F.concat(*[of(n) for n in range(1, most + 1)])


def keyword_count(text: Column, keyword: Column) -> Column:
    """Non-overlapping occurrences of a keyword, whatever the case; 0 for an empty or null keyword or text."""
    t, k = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(keyword, F.lit("")))
    return F.when(k == "", F.lit(0)).otherwise(((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.greatest(F.length(k), F.lit(1))).cast("int"))


def contains_all(text: Column, keywords: list[str | None]) -> Column:
    """Whether every keyword that is not blank occurs; true if there are none."""
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(True)
    for k in keywords:
        if k and k.strip():
            out = out & t.contains(k.lower())
    return out


def terms(text: Column, stops: list[str] | None = None) -> Column:
    """Lower-case words of two characters and more that are no stopwords (none if not given)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stops)) if stops else words


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
