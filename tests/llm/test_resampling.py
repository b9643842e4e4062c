"""Importance resampling against a plain model, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

from tests.conftest import SF
from tests.llm.test_llm import ODD, docs_of, words
from weftline.llm import resampling
from weftline.llm.queries import queries


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), Counter(zlib.crc32(g.encode()) % 10000 for g in grams)


def plain(docs, items, least=20, percent=5):
    """The rows of a list of (doc_id, text) in their order."""
    own = [(d, *features(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for x in items:
        t.update(features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    out = []
    for d, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        out.append([d, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((i for i, r in enumerate(out) if r[4] >= least), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    rank = {i: p + 1 for p, i in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_pieces_own_each_word_once():
    text = words(3000, 1) + "  ..\n" + "y" * 900 + " é,日本 " + words(40, 2)
    whole = text.encode().translate(resampling._FOLD).split()
    for size in (1, 7, 100, 1 << 16):
        got = list(resampling.pieces(text.encode(), size))[::-1]
        at = 0
        for own, some in got:
            assert some.split() == whole[at : at + own + 2]
            at += own
        assert at == len(whole) and (len(got) > 20) == (size < 1000)
    assert list(resampling.pieces(b"")) == [(0, b"")] == list(resampling.pieces(b" .,!" * 100, 8))


def test_query_equals_the_plain_model(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = queries()["op13_resampling"](spark, SF)
    assert dict(rows.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    got = [tuple(r) for r in rows.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=key) == sorted(plain(docs, items), key=key) and sum(r[4] is not None for r in got) > 5


def test_odd_rows_and_chunks_that_are_dealt_out(spark, monkeypatch):
    docs = ODD + [(100 + i, words(20 + i % 3, i)) for i in range(200)] + [(150, words(20, 51)), (None, None)]
    items = [None, "", words(50, 7)]
    target = spark.createDataFrame([(t, 1) for t in items], "text string, doc_id int")
    want = sorted(plain(docs, items), key=key)
    for size, long in ((1 << 16, 1 << 20), (300, 2000)):
        whole = resampling.chunks
        monkeypatch.setattr(resampling, "chunks", lambda d, whole=whole, size=size, long=long: whole(d, size, long))
        assert sorted((tuple(r) for r in resampling.resample(docs_of(spark, docs), target).collect()), key=key) == want
        monkeypatch.setattr(resampling, "chunks", whole)
    assert resampling.resample(docs_of(spark, []), target).count() == 0
    assert resampling.resample(docs_of(spark, ODD), target.limit(0)).count() == len(ODD)
