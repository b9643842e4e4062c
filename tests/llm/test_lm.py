"""The language model: counts and base scores against plain ones, scores token by token, sums of probabilities, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_llm import ODD, docs_of, words
from weftline.llm import lm
from weftline.llm.queries import queries


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def plain(docs):
    count = Counter()
    for d, t in docs:
        if not out(d):
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))
    return [(d, out(d), len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), n, base(t)) for d, t in docs], count


def same(rows, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 6))
    a, b = sorted((tuple(r)[:6] for r in rows), key=key), sorted(want, key=key)
    assert [r[:5] for r in a] == [r[:5] for r in b] and all(abs(x[5] - y[5]) < 1e-6 * max(1, abs(y[5])) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("known", [None, 40])
def test_query_counts_as_a_plain_model(spark, monkeypatch, known):
    """With few broadcast words, too, when most are joined."""
    if known:
        monkeypatch.setattr(lm, "KNOWN", known)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, _ = plain(docs)
    df = queries()["op11_lm_scoring"](spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    rows = df.collect()
    same(rows, want)
    assert all(r["score"] < 0 for r in rows)


def test_scores_token_by_token_and_sums_of_probabilities(spark):
    rnd = np.random.default_rng(1)
    texts = [(i, " ".join(rnd.choice([f"{'abcd'[i % 4]}{k}" for k in range(60)], 80, p=np.arange(60, 0, -1) / 1830))) for i in range(300)] + [(900 + i, f"rare{i} zz{i} q{i}") for i in range(80)]
    rows = docs_of(spark, texts).select(F.col("doc_id").alias("row"), "doc_id", lm.held_out().alias("held_out"), "text")
    voc = lm.Vocabulary(lm.word_counts(rows))
    enc = lm.encoded(rows, voc).persist()
    model = lm.trained(enc.filter("not held_out").select("row", "ids"))
    outcome = {}
    for r in enc.collect():
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        for w, i in zip(tokens(dict(texts)[r["row"]]), ids, strict=True):
            assert outcome.setdefault(w, i) == i and (w is None) == (i == lm.END)
    _, count = plain(texts)

    def step(before):
        """Probabilities of all outcomes after three."""
        a, b, c = before
        h = lambda x: (x * 0x9E3779B1 % 2**32) >> 19
        s = model.STARTS
        soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        kinds = soft(model.w[s[0] + a] + model.w[s[1] + b] + model.w[s[2] + c] + model.w[s[3] + h(a * lm.OUTCOMES + b)] + model.of_class)
        each = [soft(model.w[s[4] + h(a * 32 + k)] + model.w[s[5] + h(b * 32 + k)] + model.of_member[k]) * kinds[k] for k in range(32)]
        return np.concatenate(each)[model.place]

    inside = {}
    for w, c in count.items():
        inside.setdefault(outcome[w], []).append((w, c))

    def word(w):
        """Probability of a word within its outcome."""
        i = outcome[w]
        if i <= lm.OWN:
            return 1.0
        known = inside.get(i, [])
        n, once = sum(c for _, c in known), sum(c == 1 for _, c in known)
        unknown = (once + 0.5) / (n + 1) if known else 1.0
        return (1 - unknown) * (count[w] + 0.5) / (n + 0.5 * len(known)) if count[w] else unknown

    got = {r["doc_id"]: r["log_p"] + r["within"] for r in lm.scored(enc.drop("keys", "times"), model).collect()}  # all words are among the broadcast ones
    for d, t in texts[::37]:
        p, before = 0.0, (0, 0, 0)
        for w in tokens(t):
            all_ = step(before)
            assert abs(all_.sum() - 1) < 1e-4
            p += math.log10(all_[outcome[w]] * word(w))
            before = (outcome[w], *before[:2])
        assert abs(got[d] - p) < 1e-4 * abs(p)
    for i, known in inside.items():
        if i > lm.OWN:
            assert abs(sum(word(w) for w, _ in known) + voc.unknown[i - 1 - lm.OWN] - 1) < 1e-9
    held = [r for r in lm.language_scores(docs_of(spark, texts)).collect() if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_gradient_adds_up(spark):
    rnd = np.random.default_rng(2)
    texts = [(i, np.append(rnd.integers(1, lm.OUTCOMES, 50), lm.END).astype("<u2").tobytes()) for i in range(40)]
    df = spark.createDataFrame(texts, "row long, ids binary").repartition(3)
    counts, near = lm.neighbour_counts(df)
    all_ = np.concatenate([np.frombuffer(x, "<u2") for _, x in texts])
    assert counts.tolist() == np.bincount(all_, minlength=lm.OUTCOMES).tolist() and near.shape == (lm.OUTCOMES, 2 * lm.ANCHORS)
    place = lm.classes(near)
    assert sorted(place.tolist()) == list(range(lm.OUTCOMES))
    model = lm.Model(place, counts)
    observed, expected = lm.gradient(df, model)
    assert observed.sum() == 6 * len(all_) and abs(expected.sum() - observed.sum()) < 0.1
    assert np.allclose(observed.sum(axis=1), expected.sum(axis=1), atol=1e-3)


def test_odd_rows(spark):
    docs = ODD + [(20, "x y"), (21, "x y"), (22, words(30, 8)), (None, None)]
    rows = lm.language_scores(docs_of(spark, docs)).collect()
    same(rows, plain(docs)[0])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    held = [d for d in range(400) if out(d)][:3]
    rows = lm.language_scores(docs_of(spark, [(d, "a b") for d in held])).collect()
    assert {(r["train_tokens"], r["base_score"], r["n_known"]) for r in rows} == {(0, 0.0, 0)} and all(math.isfinite(r["score"]) for r in rows)
    assert lm.language_scores(docs_of(spark, [])).count() == 0


def test_keys_do_not_depend_on_what_stands_around(monkeypatch):
    from weftline.llm.shared import text_buffers

    texts = ["a", "b", "", "the cat", "cat", "x" * 50, " a ", "THE", "日本 a", "t"]
    whole, first = lm.word_keys(*text_buffers(pa.array(texts)))
    monkeypatch.setattr(lm, "_WINDOW", 3)
    again, _ = lm.word_keys(*text_buffers(pa.array(texts)))
    one = [lm.word_keys(*text_buffers(pa.array([t])))[0].tolist() for t in texts]
    assert whole.tolist() == again.tolist() == [k for o in one for k in o] and first.tolist() == np.cumsum([0, *map(len, one)]).tolist()
    assert one[0] == one[6] and one[3][0] == one[7][0] and one[3][1] == one[4][0] and len({k for o in one for k in o}) == 7
