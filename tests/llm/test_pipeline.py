"""Stages of the corpus pipeline on rows with null, repeated and clashing ids."""

import math

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_llm import docs_of, words


def texts_of(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows)


def plain(rows):
    return sorted((d is None, d or 0, t or "") for d, t in rows)


def test_neardup_stage_keeps_a_document_of_each_group(spark):
    a, b, c, d, e, f = (words(30, 300 + i) for i in range(6))
    near = lambda t: t + " more"
    rows = [(None, a), (None, near(a)), (None, b), (1, c), (1, d), (1, d), (2, near(d)), (None, near(c)), (3, e), (3, f), (None, None), (None, ""), (4, "")]
    got = texts_of(corpus_pipeline.neardup_stage(spark, docs_of(spark, rows), "").collect())
    ends = [x for x in got if x[2] not in (a, near(a))]
    assert len(got) == len(ends) + 1
    assert ends == plain([(None, b), (1, c), (1, d), (3, e), (3, f), (None, None), (None, ""), (4, "")])


def test_decontamination_stage_judges_each_row(spark, tmp_path):
    item = words(20, 400)
    spark.createDataFrame([(1, item), (2, words(25, 401))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = lambda seed: f"{words(10, seed)} {item} {words(10, seed + 1)}"
    clean = [(None, words(40, 410)), (None, words(40, 411)), (1, words(40, 412)), (1, words(40, 412)), (2, words(40, 413)), (None, None), (3, "")]
    rows = [*clean[:2], (None, leak(420)), *clean[2:], (1, leak(430)), (4, leak(440)), (4, leak(450))]
    assert texts_of(corpus_pipeline.decontamination_stage(spark, docs_of(spark, rows), str(tmp_path)).collect()) == plain(clean)


def test_secrets_stage_strikes_out_a_secret_beside_another(spark):
    key = "Zq8Lm2Xv9Rt4Wp7Ks1YdBn6Hc3Jf5Gt0Ua"
    got = corpus_pipeline.secrets_stage(spark, docs_of(spark, [(1, "AKIA" + "Q7" * 8 + "/" + key), (None, "plain")]), "").collect()
    assert {r["doc_id"] for r in got} == {1, None} and all(key[5:] not in r["text"] for r in got)


def test_toxicity_stage_keeps_whole_rows(spark, tmp_path):
    bad = lambda i: f"{words(20, i)} scum idiot {words(9, i + 1)}"
    rows = [(i, bad(i) if i % 3 == 0 else words(30, i)) for i in range(240)]
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows += [(None, words(30, 900)), (None, bad(901)), (1, words(30, 1)), (500, None), (501, "")]
    got = corpus_pipeline.toxicity_stage(spark, docs_of(spark, rows), str(tmp_path))
    assert got.columns == list(corpus_pipeline.COLUMNS)
    clean = [r for r in rows if "scum" not in (r[1] or "")]
    assert texts_of(got.collect()) == plain(clean) and got.filter("text is null").count() == 1


def test_packing_stage_holds_every_text(spark):
    rows = [(1, words(3000, 5)), (None, words(10, 6)), (2, None), (3, ""), (3, "")]
    got = corpus_pipeline.packing_stage(spark, docs_of(spark, rows), "").collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, None} and sum(r["length"] for r in got if r["doc_id"] == 3) == 2 and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables(spark, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, docs_of(spark, []), SF).count() == 0


def test_run_equals_plain_models_stage_by_stage(spark):
    """Over a whole small table, whose ids are distinct."""
    from tokenizers import Tokenizer

    import public_tokenizers

    from tests.llm import brute
    from weftline.llm import toxicity

    given = spark.read.parquet(f"{SF}/documents.parquet")
    at, w = toxicity.fit(given, spark.read.parquet(f"{SF}/labels.parquet"))
    weights = dict(zip(at.tolist(), w.tolist(), strict=True))
    score = lambda t: 1 / (1 + math.exp(-(sum(weights.get(i, 0) for i in brute.gram_set(t)) + weights.get(1 << 20, 0))))
    docs = {r["doc_id"]: r["text"] or "" for r in given.collect()}
    docs = {d: t for d, t in docs.items() if score(t) < 0.3}
    same = brute.components(docs, 5, 80)
    docs = {d: t for d, t in docs.items() if same[d][1] == d}
    leaks = {d for d, _ in brute.leaks(docs, {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()})}
    docs = {d: brute.redacted(t) for d, t in docs.items() if d not in leaks}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: np.asarray([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for d, t in docs.items()}
    got = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + r["ids"]
    assert got == ids and leaks and len(docs) < len(same)
