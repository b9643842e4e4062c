"""Each query of this subpackage over whole tables against plain models, SQL or an exact round trip."""

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm import brute
from weftline.llm import quality, tokencounts, toxicity
from weftline.llm.queries import oracle_sql, queries

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name, sf=SF):
    return queries()[name](spark, sf).collect()


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in texts.items()}
    cut, windows = {d: [] for d in texts}, {}
    for r in run(spark, "op1_packing"):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.asarray(own, "<u4").tobytes())
        cut[r["doc_id"]].append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, whole in [(c, len(ids[d])) for d, c in cut.items()] + [(w, None) for w in windows.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == whole if whole else at <= 2048
    assert sum(map(len, ids.values())) >= 0.9 * 2048 * (len(windows) - 4)


def test_toxicity(spark, texts):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    own = [(r["doc_id"], r["toxic"]) for r in labels.selectExpr("*", "xxhash64(doc_id) as h").orderBy("h").collect() if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in texts]
    want = brute.ftrl([(brute.gram_set(texts[d]), y) for d, y in own])
    at, w = toxicity.fit(docs, labels)
    got = dict(zip(at.tolist(), w.tolist(), strict=True))
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-6 for i in got)
    rows = run(spark, "op2_toxicity")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        s = sum(got.get(i, 0) for i in brute.gram_set(texts[r["doc_id"]])) + got.get(1 << 20, 0)
        assert abs(r["score"] - 1 / (1 + math.exp(-s))) < 1e-4 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_decontamination(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in run(spark, "op3_decontamination")}
    assert got == brute.leaks(texts, items) and got


def test_near_duplicates_of_a_larger_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run(spark, "op4_minhash_neardup", LARGER)}
    want = {d: (n, c, d == c) for d, (n, c) in brute.components(docs, 3, 85).items()}
    assert got == want and sum(not k for *_, k in want.values()) > 50


def test_secrets_of_a_larger_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()}
    rows = run(spark, "op5_secret_scan", LARGER)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    told = lambda spans: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
    for r in rows:
        spans = brute.secret_spans(texts[r["doc_id"]])
        kinds = Counter(s[3] for s in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"]) and r["spans"] == told(spans)
        assert r["base_sha256"] == hashlib.sha256(told(s for s in spans if s[3] != "entropy").encode()).hexdigest()
    assert sum(r["n_assign"] + r["n_hex"] for r in rows) > 0


def test_token_counts_over_the_real_vocabulary(spark, texts):
    import public_tokenizers

    alphabet = tokencounts.byte_alphabet()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = {bytes(alphabet[c] for c in t) for t in json.load(f)["model"]["vocab"] if all(c in alphabet for c in t)}
    longest = max(map(len, vocabulary))
    rows = {r["doc_id"]: (r["n_bytes"], r["n_words"], r["n_tokens"]) for r in run(spark, "op6_token_counts")}
    assert rows == {d: (len(t.encode()), len(t.split()), brute.greedy_count(t, vocabulary, longest)) for d, t in texts.items()}


def test_quality(spark, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op8_quality")}
    votes = {d: brute.votes(t, quality.LABELLERS) for d, t in texts.items()}
    assert {d: r["votes"] for d, r in rows.items()} == votes
    good = brute.posteriors(Counter(votes.values()))
    assert all(abs(r["weak"] - good[r["votes"]]) < 1e-6 and r["keep"] == (r["score"] >= 0.5) for r in rows.values())
    sure = [r for r in rows.values() if not 0.1 < r["weak"] < 0.9]
    assert sum(r["keep"] == (r["weak"] > 0.5) for r in sure) >= 0.9 * len(sure)


def test_all_operators_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14)) and set(oracle_sql()) <= set(queries())
