"""Runs of words against a plain model, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.test_llm import ODD, docs_of, words
from weftline.llm import repeats
from weftline.llm.queries import queries


def plain_runs(s, least=12):
    """All stretches with a smallest period that no neighbour extends, period by period."""
    n, out = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q - i), q)  # a stretch that has a smaller period is there already
            i = j + 1
    return sorted((a, m, q) for (a, m), q in out.items() if m >= least)


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_sequences(letters):
    rnd = random.Random(letters)
    for trial in range(500):
        s = [rnd.randrange(letters) for _ in range(rnd.randrange(0, 70))]
        if trial % 2:
            unit = [rnd.randrange(letters + 2) for _ in range(rnd.randrange(1, 9))]
            s = s[: rnd.randrange(10)] + unit * rnd.randrange(2, 6) + unit[: rnd.randrange(9)] + s[10 : 10 + rnd.randrange(20)]
        assert repeats.runs(np.array(s, np.int64), 2) == plain_runs(s, 2)
        assert repeats.word_runs([b"%d" % x for x in s]) == plain_runs(s)


def test_structured_sequences():
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(512)]
    for s in ([ord(c) for c in fib[-1]], thue, [0] * 700, [0, 1] * 300 + [0] * 50 + [0, 1] * 20, list(range(100)) * 2 + list(range(60))):
        assert repeats.runs(np.array(s, np.int64), 2) == plain_runs(s, 2)
        assert repeats.word_runs([b"%d" % x for x in s]) == plain_runs(s)


def test_stretches_leave_words_out_that_repeat_nothing():
    w = [b"w%d" % i for i in range(500)] + [b"x", b"y"] * 9 + [b"v%d" % i for i in range(500)] + [b"w%d" % i for i in range(40)]
    h = np.fromiter(map(hash, w), np.int64).view(np.uint64)
    assert repeats.likely(h) == [(500, 518)] and repeats.word_runs(w) == [(500, 18, 2)]


def test_query_equals_the_plain_model(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries()["op12_periodic_runs"](spark, SF)
    assert df.dtypes == [(c, "string" if "sha" in c else "bigint") for c in COLUMNS]
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=key) == sorted((plain_row(d, t) for d, t in docs if len((t or "").split()) < 4000), key=key) and sum(r[1] > 0 for r in got) >= 15


def test_odd_rows(spark):
    docs = [x for x in ODD if len(x[1] or "") < 200_000] + [(11, "ha " * 30), (11, "ha " * 30), (12, "a b " * 6 + "c " + "a b " * 6), (13, " ".join(["x"] * 5)), *((i, words(40, i)) for i in range(300, 340)), (None, None)]
    df = repeats.periodic_runs(docs_of(spark, docs), repeats.with_period)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted((plain_row(*x) for x in docs), key=key)
    long = words(3000, 1) + " " + (words(400, 2) + " ") * 80
    row = repeats.periodic_runs(docs_of(spark, [(1, long)])).first()
    assert (row["n_runs"], row["length"], row["period"], row["exponent_milli"]) == (1, 32_000, 400, 80_000)
    assert repeats.periodic_runs(docs_of(spark, [])).count() == 0
