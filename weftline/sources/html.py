"""Pages: titles, descriptions, main text, dates and links of HTML, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import datetime as dt
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that hold no content, and paths that are no articles.
SKIP = ("script", "style", "noscript", "template", "nav", "footer", "aside", "header")
#: Elements of which no text shows.
HIDDEN = ("script", "style", "template")
NO_ARTICLE = ("/tag/", "/category/", "/cart", "/account", "/login", "/search")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Where a page may say when it was published, the most telling first.
DATES = (("meta", "property", "article:published_time", "content"), ("meta", "name", "article:published_time", "content"), ("meta", "name", "pubdate", "content"), ("meta", "name", "publish_date", "content"), ("meta", "name", "date", "content"), ("time", "datetime", None, "datetime"), ("meta", "itemprop", "datePublished", "content"))


class Page(HTMLParser):
    """What a page says, read once. A paragraph ends where the next begins, so unclosed ones repeat nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.metas, self.times, self.hrefs = [], [], []
        self.title, self.in_title, self.skip = None, False, []
        self.depth = {"article": 0, "main": 0, "body": 0}
        self.text = {k: [] for k in ("article", "main", "body", "all")}
        self.paragraphs = {k: [] for k in ("article", "main", "body", "all")}
        self.done, self.p = set(), None
        self.every, self.any = [], None  # paragraphs wherever they are, and the one that is open, with what is skipped around it

    def _roots(self) -> list[str]:
        return ["all", *(k for k, d in self.depth.items() if d and k not in self.done)]

    def _end_p(self) -> None:
        if self.p is not None:
            t = " ".join(x for x in (s.strip() for s in self.p[1]) if x)
            for root in self.p[0]:
                self.paragraphs[root].append(t)
        self.p = None

    def _end_any(self) -> None:
        if self.any is not None:
            self.every.append(" ".join(x for x in (s.strip() for s in self.any[1]) if x))
        self.any = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "meta":
            self.metas.append(a)
        elif tag == "time":
            self.times.append(a)
        elif tag == "a" and a.get("href") is not None:
            self.hrefs.append(a["href"].strip())
        if tag in SKIP:
            self.skip.append(tag)
        elif tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        elif tag == "p" and not any(x in HIDDEN for x in self.skip):
            self._end_any()
            self.any = (len(self.skip), [])
            if not self.skip:
                self._end_p()
                self.p = (self._roots(), [])
        if tag in self.depth and not self.skip:
            self.depth[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
            if self.any is not None and len(self.skip) < self.any[0]:
                self._end_any()
        elif tag == "title":
            self.in_title = False
        elif tag == "p":
            self._end_p()
            self._end_any()
        elif tag in self.depth and self.depth[tag]:
            self._end_p()
            self._end_any()
            self.depth[tag] -= 1
            if not self.depth[tag]:
                self.done.add(tag)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
            return
        if self.any is not None and not any(x in HIDDEN for x in self.skip):
            self.any[1].append(data)
        if not self.skip:
            for root in self._roots():
                self.text[root].append(data)
            if self.p is not None:
                self.p[1].append(data)

    def meta(self, *wanted: tuple[str, str]) -> str | None:
        return next((m.get("content") for k, v in wanted for m in self.metas if m.get(k) == v), None)


def read(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    page._end_p()
    page._end_any()
    return page


def _clean(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def _main(page: Page) -> str:
    root = next((k for k in ("article", "main", "body") if page.depth[k] or k in page.done), "all")
    return _clean("\n\n".join(page.paragraphs[root]) if page.paragraphs[root] else " ".join(page.text[root]))


def _extract(html: pd.Series) -> pd.DataFrame:
    """og:title or title; description or og:description; the paragraphs of article, main or body, or all its text."""
    def one(h):
        p = read(h)
        return _clean(p.meta(("property", "og:title")) if p.meta(("property", "og:title")) is not None else p.title), _clean(p.meta(("name", "description"), ("property", "og:description"))), _main(p)

    return pd.DataFrame([one(h) for h in html], columns=["title", "meta_description", "content"])


def _extract_competitor(html: pd.Series) -> pd.DataFrame:
    """title or og:title; all paragraphs, those of headers, footers, menus and asides too; their words."""
    def one(h):
        p = read(h)
        text = _clean(" ".join(p.every))
        return _clean(p.title or p.meta(("property", "og:title"))), text, len(text.split())

    return pd.DataFrame([one(h) for h in html], columns=["title", "content", "word_count"])


def published(page: Page) -> str | None:
    """The first date that one of the usual places holds, as ISO 8601; of a value that is none, the first YYYY-MM-DD."""
    for tag, key, value, attr in DATES:
        found = [m for m in (page.metas if tag == "meta" else page.times) if key in m and (value is None or m[key] == value)]
        if found and found[0].get(attr):
            text = found[0][attr].strip()
            for form in (text.replace("Z", "+00:00"), *re.findall(r"\d{4}-\d{2}-\d{2}", text)[:1]):
                try:
                    return dt.datetime.fromisoformat(form).isoformat()
                except ValueError:
                    continue
    return None


def _publish_date(html: pd.Series) -> pd.Series:
    return html.map(lambda h: published(read(h)))


def _hrefs(html: pd.Series) -> pd.Series:
    """The hrefs of all anchors, in order."""
    return html.map(lambda h: read(h).hrefs)


def _article_links(url: pd.Series, html: pd.Series) -> pd.Series:
    """Links of the page's own host that may be articles, absolute, without repeats."""
    def one(u, h):
        host, out = urlparse(u or "").netloc, {}
        for x in read(h).hrefs:
            try:
                full = urljoin(u or "", x)
                to = urlparse(full)
            except ValueError:
                continue
            if to.netloc == host and not any(s in to.path.lower() for s in NO_ARTICLE):
                out[full] = None
        return list(out)

    return pd.Series([one(u, h) for u, h in zip(url, html, strict=True)])


def _udf(f, kind: str):
    """A column function of an Arrow batch function, made when it is called, as workers import this module too."""
    def call(*columns):
        return F.pandas_udf(f, kind)(*columns)

    call.__doc__ = f.__doc__
    return call


def terminated(html: Column | str) -> Column:
    """HTML in which only references that a semicolon ends are read; any other ampersand stands for itself."""
    return F.regexp_replace(html, "&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)", "&amp;")


extract = _udf(_extract, "title string, meta_description string, content string")
extract_competitor = _udf(_extract_competitor, "title string, content string, word_count int")
publish_date = _udf(_publish_date, "string")
hrefs = _udf(_hrefs, "array<string>")
article_links = _udf(_article_links, "array<string>")
