"""Each operator against a plain model, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from weftline.llm import chat, decontamination, linear, neardup, packing, quality, secrets, tokencounts, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, sig string, row long, votes string"


def docs_of(spark, texts):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1.0, "x", 5, "v") for d, t in texts], DOCS)


def words(n, seed=0, pool=4000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(pool)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One Two"), (5, "One Two"), (None, words(30, 3)), (6, words(40_000, 4)), (7, "x" * 300_000), (8, words(30, 3))]


@pytest.fixture(scope="session")
def odd(spark):
    return docs_of(spark, ODD).persist()


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(odd).collect()
    got, fill = {}, {}
    for r in rows:
        assert r["length"] > 0
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for parts in fill.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048
    for d, text in ODD:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = sorted(got[(d, len(ids) // 4)])
        copies = sum(x == (d, text) for x in ODD)
        assert b"".join(p for _, p in pieces[::copies]) == ids
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_packing_encodes_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(1)
    parts = ["a", "b,", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "é", "<|endoftext|>", "\0", "1", "日本", "!", "...", ",", "\r\n", "\x85", "x."]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(14))) for _ in range(4000)]
    texts += [f"x{chr(c)}y {chr(c)} 1{chr(c)}\n{chr(c)}z{chr(c)}{chr(c)} '{chr(c)}" for c in [*range(1, 0x3000), *range(0x3000, 0x30000, 37)] if not 0xD800 <= c < 0xE000]
    texts += ["x" * 300_000, " " * 50_000, "1" * 50_000, "".join(rnd.choices("abcé日", k=30_000))]
    assert list(map(packing.encoder(None), texts)) == [np.asarray(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    whole = "".join(rnd.choices([" ", "  ", "a", "bc", "\n", "é", ","], k=3000))
    cut = list(packing.stretches(whole, 100))
    assert "".join(cut) == whole and len(cut) > 10
    assert b"".join(map(packing.encoder(None), cut)) == packing.encoder(None)(whole)


def test_karmarkar_karp():
    rnd = random.Random(3)
    sizes = [rnd.randrange(1, 512) for _ in range(300)]
    found = packing.karmarkar_karp(sizes, 40)
    assert sorted(i for w in found for i in w) == list(range(300))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) - min(sums) <= 16
    assert packing.windows([600] * 7, 1000) and len(packing.windows([600] * 7, 1000)) == 7 and packing.windows([], 10) == []


def test_toxicity(spark, odd):
    rnd = random.Random(5)
    texts, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = words(rnd.randrange(5, 120), i).split()
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["idiot", "scum", "moron"])
        texts.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, lab = docs_of(spark, texts), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in rows.items() if r["held_out"]} == set(held)
    assert sum(rows[i]["predicted"] == y for i, y in labels if i in set(held)) / len(held) > 0.95
    got = toxicity.toxicity(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(odd.limit(0), model).count() == 0
    none = toxicity.fit(docs, lab.limit(0))
    assert {r["score"] for r in toxicity.toxicity(odd, none).collect()} == {0.5}
    kept = toxicity.toxic_flags(odd, model)
    assert set(kept.columns) == {*odd.columns, "predicted"} and kept.count() == len(ODD)


def test_decontamination(spark, odd):
    items = {i: words(20 + i, 100 + i) for i in range(12)} | {20: words(25, 103), 21: "", 22: "three short words"}
    items[20] = items[3]
    rnd = random.Random(8)
    texts = {}
    for i in range(60):
        w = words(80, 1000 + i).split()
        own = items[i % 12].split()
        if i % 3 == 1:
            own[rnd.choice((0, 1, -1, len(own) // 2))] = "changed"
        if i % 3 == 2:
            own = own[: len(own) * rnd.randrange(5, 11) // 10]
        w[10:10] = own if i % 4 else []
        texts[i] = " ".join(w)
    texts |= {100: items[5], 101: items[5].upper() + "!", 102: "Three, short words", 103: " ".join([items[2]] * 3), 104: items[4].rsplit(" ", 2)[0]}
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items.items()] + [(30, None, 1.0)], "item_id long, text string, similarity double")
    got = decontamination.decontaminate(docs_of(spark, texts.items()), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == brute.leaks(texts, items)
    assert decontamination.decontaminate(odd, bench).count() == 0
    assert decontamination.decontaminate(odd, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(odd.limit(0), bench).count() == 0


def test_decontamination_judges_repeated_rows_and_long_texts(spark):
    item = words(22, 61)
    texts = [(1, f"{words(9, 62)} {item}"), (1, f"{words(9, 62)} {item}"), (1, words(30, 63)), (None, item), (2, f"{words(30_000, 64)} {item} {words(30_000, 65)}"), (3, " ".join([item] * 200))]
    bench = spark.createDataFrame([(7, item), (7, item), (8, words(18, 66))], "item_id long, text string")
    got = decontamination.decontaminate(docs_of(spark, texts), bench)
    assert sorted(((r["doc_id"] or 0, r["item_id"], r["pos"], r["similarity"]) for r in got.collect())) == sorted([(d, 7, p, 1.0) for d, p in ((0, 0), (1, 9), (1, 9), (2, 30_000), (3, 0))] * 2)


def test_fingerprints_within_the_radius_all_meet(spark):
    """And of random pairs few do."""
    rnd = random.Random(11)
    items = [rnd.getrandbits(64) for _ in range(300)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = [x ^ sum(1 << b for b in rnd.sample(range(64), decontamination.RADIUS)) for x in items]
    profile = spark.createDataFrame([(i, 20, signed(x)) for i, x in enumerate(items)], "item long, size int, fp long")
    window = spark.createDataFrame([(20, signed(x)) for x in near] + [(21, signed(items[0]))], "size int, fp long")
    got = {(r["fp"], r["item"]) for r in decontamination.candidates(window, profile, 300, decontamination.RADIUS).collect()}
    want = {(signed(y), i) for y in near for i, x in enumerate(items) if (x ^ y).bit_count() <= decontamination.RADIUS}
    assert got == want and len(want) >= 300
    masks = [set(decontamination._neighbours(w, decontamination.RADIUS // len(decontamination.BLOCKS))) for w in decontamination.BLOCKS]
    at = [sum(decontamination.BLOCKS[:b]) for b in range(len(masks))]
    meet = [any(((x ^ y) >> lo) & ((1 << w) - 1) in m for lo, w, m in zip(at, decontamination.BLOCKS, masks, strict=True)) for x, y in zip(items, items[1:], strict=False)]
    assert sum(meet) < 0.35 * len(meet)


def test_decontamination_splits_at_signs_of_any_script(spark):
    signs = ["\uff0c", "\uff1a", "\uff01", "\u060c", "\u0964", "\u20ac", "\u2192", "\u2713", "\u2502", "\U0001f600", "\u00d7", "\u00f7", "_", "\u2014"]
    items = {0: words(20, 70), 1: " ".join(f"сло{i}во" for i in range(20)), 2: " ".join(f"語{i}" for i in range(20))}
    texts = {10 * k + i: words(8, 80 + i) + s + s.join(t.split()) + s + words(8, 90 + i) for k, s in enumerate(signs) for i, t in items.items()}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.decontaminate(docs_of(spark, texts.items()), bench).collect()}
    assert got == brute.leaks(texts, items) == {(d, d % 10) for d in texts}


def test_fingerprints_agree_with_votes_counted_by_bit(spark):
    rnd = random.Random(2)
    f = [(rnd.getrandbits(64) - (1 << 63), rnd.randrange(1, 80)) for _ in range(30)]
    got = spark.createDataFrame([(f,)], "f array<struct<sh:long,wt:long>>").select(decontamination.fingerprint(F.col("f")).alias("x")).first()["x"]
    want = sum(1 << b for b in range(64) if 2 * sum(w for h, w in f if (h >> b) & 1) > sum(w for _, w in f))
    assert got % (1 << 64) == want


def test_neardup(spark, odd):
    rnd = random.Random(4)
    texts = {}
    for g in range(40):
        base = words(rnd.randrange(20, 120), 500 + g).split()
        for c in range(rnd.randrange(1, 8)):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 18)):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(999)}"
            texts[len(texts)] = " ".join(w).upper() if c == 2 else " ".join(w)
    want = brute.components(texts, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs_of(spark, texts.items()), 3, 85).collect()}
    assert got == want
    rows = neardup.near_duplicates(odd, 3, 85, keep=("lang",)).collect()
    assert len(rows) == len(ODD) and all(r["lang"] == "en" for r in rows)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[4] == (1, 4, True) and by[5] == (1, 5, True)
    assert by[8][1:] == (8, True) and by[None][1] == 8
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 1 << 63, 900).astype(np.uint64))
    b = np.unique(np.concatenate((a[:800], rnd.integers(0, 1 << 63, 100).astype(np.uint64))))
    k = neardup.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(k[0], k[1]) == k[2]).all()
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(neardup.joint_estimate(k[:1], k[1:2], np.array([len(a)]), np.array([len(b)]))[0] - j) < 0.1
    assert (1 - 0.85 ** neardup.bands_for(0.85)[0]) ** neardup.bands_for(0.85)[1] <= 1e-5


def test_secrets(spark, odd):
    rnd = random.Random(6)
    parts = ["password=", "Token: ", 'api_key = "', "secret", "abc", "token=token:abcdefgh", "AKIA", "ABCDEFGHIJKLMNOP23", "0123456789abcdef" * 2, "é", " ", "\n", "=", ":", "'", "𝒳", "Zq8Lm2Xv9Rt4Wp7Ks1Yd", "https://a/b", "hello_world_long_name_here", "deadbeefcafe"]
    texts = {i: "".join(rnd.choices(parts, k=rnd.randrange(1, 12))) for i in range(300)}
    rows = secrets.scan_secrets(docs_of(spark, texts.items())).select("doc_id", "secrets").collect()
    for r in rows:
        t = texts[r["doc_id"]]
        base, more = brute.base_spans(t), []
        for m in re.finditer(secrets.CANDIDATE, t):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(re.search(a, m[0]) for a in secrets.ALLOW) and (hot := brute.entropy_range(m[0], secrets.CLASSES)):
                s, e = m.start() + hot[0], m.start() + hot[1] + secrets.WINDOW
                if not any(b[0] < e and s < b[2] for b in base):
                    more.append((s, 3, e, "entropy"))
        assert [tuple(x) for x in r["secrets"]] == sorted(base + more)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs_of(spark, texts.items())).collect()}
    for r in rows:
        t, out, at = texts[r["doc_id"]], "", 0
        for s in r["secrets"]:
            if s["end"] > at:
                out += t[at : max(at, s["start"])] + ("[REDACTED]" if s["start"] >= at or at == 0 else "")
                at = s["end"]
        assert clean[r["doc_id"]] == out + t[at:]
    got = secrets.scan_secrets(odd.withColumn("secrets", F.lit(1)))
    assert got.count() == len(ODD) and got.filter(F.size("secrets") > 0).count() == 0
    assert secrets.scan_secrets(odd.limit(0)).count() == 0
    assert spark.createDataFrame([("token=abcdef " * 700,)], "text string").select(F.size(secrets.base_spans(F.col("text"), "assign"))).first()[0] == 700


def test_secrets_beside_base_matches(spark):
    rnd = random.Random(12)
    token = lambda n: "".join(rnd.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", n))
    own, k, h = "AKIA" + "Q7" * 8, token(40), "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
    texts = {1: f"x {own}/{k} y", 2: f"{h}/{k}", 3: f"{k}-token=abcdef", 4: f"{k}/{own}/{token(40)}", 5: f"é {h}_short9", 6: k, 7: "token=abcdef"}
    found = secrets.scan_secrets(docs_of(spark, texts.items()), beside=True).select("doc_id", "secrets").collect()
    for r in found:
        t, want = texts[r["doc_id"]], brute.base_spans(texts[r["doc_id"]])
        for m in re.finditer(secrets.CANDIDATE, t):
            bits = next(b for p, b in secrets.CLASSES.items() if re.fullmatch(p, m[0]))
            if not re.search("[0-9]", m[0]) or not re.search("[A-Za-z]", m[0]) or any(re.search(a, m[0]) for a in secrets.ALLOW):
                continue
            free = [i for i in range(m.start(), m.end() - 19) if not any(b[0] < i + 20 and i < b[2] for b in want if b[3] != "entropy")]
            hot = [i for i in free if brute.entropy_range(t[i : i + 20], {".+": bits})]
            for group in {max((b[2] for b in brute.base_spans(t) if b[2] <= i), default=0): None for i in hot}:
                own_hot = [i for i in hot if max((b[2] for b in brute.base_spans(t) if b[2] <= i), default=0) == group]
                want.append((own_hot[0], 3, own_hot[-1] + 20, "entropy"))
        assert [tuple(x) for x in r["secrets"]] == sorted(want)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs_of(spark, texts.items()), beside=True).collect()}
    assert all(k not in clean[d] and k[5:35] not in clean[d] for d in (1, 2, 3, 4, 6))
    assert {r["doc_id"]: sum(x["kind"] == "entropy" for x in r["secrets"]) for r in found} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 0, 6: 1, 7: 0}


def test_secrets_in_very_long_texts(spark):
    rnd = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rnd.choices(letters[:62], k=24)) for _ in range(20_000)]
    texts = {
        0: "ab-" * 333_333 + "1a", 1: "a-a" * 333_333 + "1", 2: "".join(rnd.choices(letters, k=600_000)), 3: " ".join(f"token=abc{i:06d}" for i in range(100_000)),
        4: " é ".join(keys), 5: "_".join("".join(rnd.choices("0123456789abcdef", k=26)) for _ in range(20_000)),
    }
    found = {r["doc_id"]: [tuple(x) for x in r["secrets"]] for r in secrets.scan_secrets(docs_of(spark, texts.items()), beside=True).select("doc_id", "secrets").collect()}
    for d in (0, 1, 3, 5):
        assert found[d] == brute.base_spans(texts[d])
    first, last = brute.entropy_range(texts[2], secrets.CLASSES)
    assert found[2] == [(first, 3, last + 20, "entropy")]
    starts = list(range(0, 27 * len(keys), 27))
    hot = [(s, brute.entropy_range(k, secrets.CLASSES)) for s, k in zip(starts, keys, strict=True) if re.search("[0-9]", k)]
    assert found[4] == [(s + h[0], 3, s + h[1] + 20, "entropy") for s, h in hot if h]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs_of(spark, texts.items()), beside=True).collect()}
    assert clean[3] == " ".join(["[REDACTED]"] * 100_000) and clean[0] == texts[0] and clean[5] == "_".join(["[REDACTED]"] * 20_000)


def test_running_sums_and_maxima(spark):
    rnd = random.Random(3)
    values = [rnd.randrange(1000) for _ in range(1000)]
    df = spark.createDataFrame([(values,), ([],)], "v array<long>").select(secrets.running(F.col("v")).alias("s"), secrets.running(F.col("v"), most=True).alias("m"))
    got = df.collect()
    assert got[0]["s"] == [sum(values[:i]) for i in range(1000)] and got[0]["m"] == [max([0, *values[:i]]) for i in range(1000)] and got[1]["s"] == got[1]["m"] == []


def test_token_counts(spark, odd):
    vocabulary = {b"a", b"b", b"ab", b"abc", b"bc", b"abcd", b"cde", b"c", b"d", b"e", b" ", b" a", b" ab"}
    machine = tokencounts.LongestMatch(vocabulary, b" ")

    def greedy(w):
        n = i = 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in vocabulary), None)
            if j is None:
                return 1
            i, n = j, n + 1
        return n

    rnd = random.Random(7)
    for _ in range(4000):
        w = bytes(rnd.choices(b"abcdex", weights=[5, 5, 5, 5, 5, 1], k=rnd.randrange(0, 12)))
        assert machine.count(w) == greedy(b" " + w)
    rows = [(r["doc_id"], r["n_words"], r["n_tokens"]) for r in tokencounts.token_counts(odd).collect()]
    assert len(rows) == len(ODD) and (1, 0, 0) in rows and (3, 0, 0) in rows and rows.count((5, 2, 2)) == 2
    assert tokencounts.token_counts(odd.limit(0)).count() == 0


def warc_pages(spark):
    rows = [(i // 3, f"https://a.example/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(900)] + [(None, None, None), (1, "u", "same"), (1, "u", "same"), (2, "long", "x" * 300_000), (3, "", "")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, volume string")


def test_warc_index(spark):
    rows, pages = warc_pages(spark)
    got = sorted(warc.volumes(pages).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r["volume"], r["leaf"]) for r in got] == [(i, i // 256, i % 256) for i in range(len(rows) - 1)]
    assert [r["page_id"] for r in got] == sorted((r[0] for r in dict.fromkeys(rows)), key=lambda x: -1 if x is None else x) and sum(r["copies"] for r in got) == len(rows)
    for a, b in zip(got[:-1], got[1:], strict=True):
        assert b["start"] == (a["start"] + a["length"] * a["copies"] if a["volume"] == b["volume"] else 0)
    assert warc.volumes(pages.limit(0)).count() == 0


def test_warc_audit_finds_each_difference_once(spark):
    rows, pages = warc_pages(spark)
    index = warc.volumes(pages).persist()
    same = warc.records(pages)
    assert warc.audit(index, same).count() == 0 and warc.fixity(index, same).filter("status = 'ok'").count() == len(rows) - 1
    replica = [r for r in rows if r[1] != "https://a.example/601"]  # one missing
    replica.remove((1, "u", "same"))  # one copy of two
    replica = [(*r[:2], r[2] + "!") if r[1] == "https://a.example/42" else r for r in replica]  # one corrupt
    replica += [(d, "new", str(n)) for d, n in ((9999, 1), (-7, 2), (9999, 3))] + [(None, "null", "extra")]  # extra ones at the ends and among nulls
    other = warc.records(spark.createDataFrame(replica, "page_id long, url string, html string"))
    by = {r["sha256"]: r for r in index.collect()}
    found = [(r["page_id"], r["status"], r["copies"], r["sha256"] in by) for r in warc.audit(index, other).collect()]
    want = [(200, "missing", 1, True), (1, "missing", 1, True), (14, "corrupt", 1, True), (9999, "extra", 1, False), (9999, "extra", 1, False), (-7, "extra", 1, False), (None, "extra", 1, False)]
    assert sorted(found, key=str) == sorted(want, key=str)
    told = warc.fixity(index, other).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in told} == {"ok": len(rows) - 4, "missing": 2, "corrupt": 1, "extra": 4}
    assert warc.audit(index, same.limit(0)).count() == len(rows) - 1
    assert {r["status"] for r in warc.audit(warc.volumes(pages.limit(0)), same).collect()} == {"extra"}


def test_warc_places_records_over_many_partitions(spark):
    pages = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    index = warc.volumes(pages).persist()
    got = warc.placed(warc.records(pages).repartition(7), index).join(index.select("sha256", "rank"), "sha256")
    assert got.count() == 5000 and got.filter("slot <> floor(rank / 16)").count() == 0


def test_warc_descends_from_one_root_to_what_differs(spark):
    pages = spark.range(10_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    index = warc.volumes(pages).persist()
    place = lambda df: warc.placed(warc.records(df), index)
    ours = warc.tree(place(pages), 624)
    assert [x.count() for x in ours] == [625, 40, 3, 1]
    assert [x.count() for x in warc.descend(ours, warc.tree(place(pages.repartition(3)), 624))] == [0, 0, 0, 0]
    byte = pages.withColumn("html", F.when(F.col("page_id") == 7777, "7778").otherwise(F.col("html")))
    assert [x.count() for x in warc.descend(ours, warc.tree(place(byte), 624))] == [1, 1, 1, 1]
    changed = byte.filter("page_id <> 20").union(spark.range(40).select(F.lit(5000), F.lit("new"), F.col("id").cast("string")))
    assert [x.count() for x in warc.descend(ours, warc.tree(place(changed), 624))] == [1, 2, 3, 3]
    found = {(r["page_id"], r["status"]): r["n"] for r in warc.audit(index, warc.records(changed)).groupBy("page_id", "status").agg(F.sum("copies").alias("n")).collect()}
    assert found == {(20, "missing"): 1, (7777, "corrupt"): 1, (5000, "extra"): 40}


def test_warc_slots_hash_order_and_places(spark):
    """The same lengths and digests under other ids or in other copies are another slot."""
    rows = [(1, "a" * 64, 10, 1, 0), (2, "b" * 64, 12, 1, 0), (None, "c" * 64, 5, 2, 0)]
    kinds = "page_id long, sha256 string, length long, copies long, slot long"
    told = lambda rows: warc.tree(spark.createDataFrame(rows, kinds), 0)[0].collect()
    first = told(rows)
    assert told(rows[::-1]) == first and [r["bytes"] for r in first] == [32]
    for other in ([(2, *rows[0][1:]), (1, *rows[1][1:]), rows[2]], [*rows[:2], (None, "c" * 64, 10, 1, 0)], [*rows[:2], (0, *rows[2][1:])], rows[:2]):
        assert told(other)[0]["hash"] != first[0]["hash"]
    assert told([]) == []


def test_quality(spark, odd):
    rnd = random.Random(9)
    texts = {}
    for i in range(400):
        w = words(rnd.randrange(30, 200), i, 300).split()
        w = [x + rnd.choice(["", "", "", ",", "."]) for x in w]
        texts[i] = " ".join(x + "!!" for x in w).upper() if i % 8 == 0 else " | ".join(w) if i % 8 == 1 else " ".join(w)
    got = {r["doc_id"]: r["keep"] for r in quality.quality(docs_of(spark, texts.items())).collect()}
    right = sum(got[i] == (i % 8 > 1) for i in texts)
    assert right >= 0.97 * len(texts)
    assert quality.quality(odd).count() == len(ODD) and quality.quality(odd.limit(0)).count() == 0


def test_expectation_maximisation_finds_the_classes():
    p = quality.expectation_maximisation(["111", "11-", "001", "000", "---"], np.array([80.0, 5, 9, 6, 3]))
    assert p[0] > 0.9 and p[1] > 0.8 and p[3] < 0.2


def test_chat_reads_back(spark):
    rnd = random.Random(10)
    parts = ["<|", "<&|", "[INST]", "[/INST]", "</s>", "<s>", "&", "<", "|>", "<|join|>", "é", "\n", " "]
    rows = [(i % 25, rnd.randrange(6), rnd.choice(["user", "assistant", "system", None, "a<|turn|>"]), rnd.choice([None, "", "".join(rnd.choices(parts, k=6))]), 1) for i in range(200)] + [(None, None, "assistant", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(df)
    for r in out.withColumn("turns", chat.read_chats(F.col("formatted"))).collect():
        own = sorted((t if t is not None else -1, ro or "", x or "") for c, t, ro, x, _ in rows if c == r["conv_id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(ro, x) for _, ro, x in own]
        masked = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
        assert [re.sub(r"([<\[])&(&|\||/?s>|/?INST\])", r"\1\2", m) for m in masked] == [x for _, ro, x in own if ro == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_of_long_texts_and_many_turns(spark):
    long = "</s><|turn|>[INST] é " * 15_000
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i} <|end|>") for i in range(3000)] + [(2, 0, "assistant", long), (2, 1, "assistant", long), (3, 0, None, None)]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("turns", chat.read_chats(F.col("formatted"))).collect()}
    for c in (1, 2, 3):
        own = [(ro or "", t or "") for d, _, ro, t in rows if d == c]
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == own and len(out[c]["loss"]) == sum(ro == "assistant" for ro, _ in own)


def test_top_k(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.choice([-0.5, 0.25, 0.0, 0.1], 6 + i % 2)]) for i in range(120)]
    odd = [(None, [1.0]), (500, None), (501, [float("nan")]), (502, [1.0, None]), (503, []), (504, [float("inf")]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<float>, score int")
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in [*rows, (503, []), odd[-1]]]
    want = set()
    for q, a in good[:120:10]:
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:5]
        want |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    ask = df.filter("vec_id % 10 = 0 and vec_id < 120")
    assert {tuple(r) for r in topk.top_k(df, ask).collect()} == want
    assert {tuple(r) for r in topk.top_k(df, ask, block=4).collect()} == want
    assert topk.top_k(df.limit(0), ask).count() == 0 and topk.top_k(df, ask.limit(0)).count() == 0


def test_top_k_asks_each_row(spark):
    rnd = np.random.default_rng(4)
    rows = [(i // 3 * 10 if i < 30 else i, [float(x) for x in rnd.choice([-0.5, 0.25, 0.1], 5)]) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:4] + [(None, [1.0]), (20, None)], "vec_id long, embedding array<float>")
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows + rows[:4]]
    want = []
    for at, (q, a) in enumerate(good):
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, (i, b) in enumerate(good) if n != at)[:5]
            want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    for block in (3, 1000):
        assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, block=block).collect()) == sorted(want)


def test_ftrl_leaves_noise_at_zero():
    model = linear.Ftrl(10, 0.6, 1.0, 3.0, 1.0)
    rnd = random.Random(1)
    for i in range(2000):
        model.learn(np.array(sorted({rnd.randrange(1000), 1001 + i % 2})), float(i % 2))
    w = model.weights(slice(None))
    assert w[1002] - w[1001] > 1
    assert np.count_nonzero(w[:1000]) < 100


@pytest.mark.parametrize("name", ["op7_warc_fixity", "op9_chat_format", "op10_topk"])
def test_queries_equal_their_sql(spark, duck, name):
    from tests.conftest import SF, normal
    from weftline.llm import queries

    df, got = queries.queries()[name](spark, SF), duck.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(got.fetchall(), columns)
