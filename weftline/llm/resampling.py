"""Target-distribution importance resampling: hashed n-gram bags of raw and target texts, log-ratio weights, a Gumbel top-k draw.

Texts are taken in chunks that overlap: a chunk owns the features that start at its words, and carries the n - 1 words
behind them along. What chunks count is summed by document, so a text's length decides neither memory nor, as chunks of
long texts are dealt out, a task's time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.tables import written

from .shared import ASCII_LOWER, WORD_BYTES, null_safe_text, release, short_batches

#: Words of a feature at most, and buckets of features.
LONGEST, BUCKETS = 3, 10_000
#: Bytes of a chunk's own words, about; bytes of a text from which on its chunks are dealt out to all tasks.
CHUNK, LONG = 1 << 16, 1 << 20
#: A byte as it counts: lower case, or a space where no word has it.
_FOLD = bytes(int(ASCII_LOWER[b]) if WORD_BYTES[b] else 32 for b in range(256))
_CHUNKS = "row long, doc_id long, first boolean, own long, words binary"


def pieces(text: bytes, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """The chunks of a text from its last to its first: the number of words that each owns, and those words with up to LONGEST - 1 that follow.

    They are cut at word boundaries, so a word longer than ``size`` makes a longer chunk. A text without words has one empty chunk.
    """
    t, some, behind = text.translate(_FOLD), False, []
    end = len(t)
    while end > 0:
        at = t.rfind(b" ", 0, end - size + 1) if end > size else -1
        own = t[at + 1 : end].split()
        end = at
        if own:
            some = True
            yield len(own), b" ".join(own + behind)
            behind = (own + behind)[: LONGEST - 1]
    if not some:
        yield 0, b""


def buckets(words: bytes, own: int, n: int = BUCKETS) -> np.ndarray:
    """The buckets of the features that start at a chunk's first ``own`` words. A checksum goes on where that of the feature's first words ended."""
    first = words.split()
    spaced = [b" " + w for w in first]
    sums = list(map(crc32, first))
    found = [sums[:own]]
    for k in range(1, LONGEST):
        sums = list(map(crc32, spaced[k:], sums))
        found.append(sums[:own])
    return np.fromiter((x for part in found for x in part), np.int64, sum(map(len, found))) % n


def chunks(docs: DataFrame, size: int = CHUNK, long: int = LONG) -> DataFrame:
    """row, doc_id, first, own and words: the chunks of every row of (doc_id, text). ``row`` numbers rows, and ``first`` marks one chunk of each.

    Chunks of texts of more than ``long`` bytes are dealt out, so that one text does not keep one task busy.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows_ = 0, []
            for i, (row, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                first = True
                for own, words in pieces(batch.column(2)[i].as_py().encode(), size):
                    rows_.append((row, doc_id, first, own, words))
                    first, held = False, held + len(words)
                    if held > 16 * size:
                        yield _batch(rows_)
                        held, rows_ = 0, []
            if rows_:
                yield _batch(rows_)
        release()

    short_batches(docs.sparkSession)
    wide = F.octet_length("text") > long
    here = rows.filter(~wide).withColumn("row", F.col("row") * 2).mapInArrow(run, _CHUNKS)
    dealt = rows.filter(wide).withColumn("row", F.col("row") * 2 + 1).mapInArrow(run, _CHUNKS)
    return here.unionAll(dealt.repartition("row", "first", F.xxhash64("words")))


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "doc_id", "first", "own", "words"])


def feature_counts(parts: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """How many features of all chunks are in each bucket. A task sends one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for own, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += np.bincount(buckets(words.as_py(), own, n), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = parts.select("own", "words").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # n rows at most
    out = np.zeros(n, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target and in the raw texts, with one added to each bucket, rounded down."""
    s_all, t_all, n = float(raw.sum() + len(raw)), float(target.sum() + len(raw)), len(raw)
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * s_all / ((float(raw[i]) + 1) * t_all))) for i in range(n)], np.int64)


def noise(doc_id: int | None, seed: int = 42) -> int:
    """Thousandths of a Gumbel deviate that a document's id decides, rounded down. A null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(parts: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """row, doc_id, n_words, n_features, weight and noise of each document, summed over its chunks."""
    shared = parts.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            own, ids, first = (batch.column(c).to_pylist() for c in ("own", "doc_id", "first"))
            found = [buckets(w.as_py(), n, len(gain)) for n, w in zip(own, batch.column("words"), strict=True)]
            more = [[len(f) for f in found], [int(gain[f].sum()) for f in found], [noise(d, seed) if one else 0 for d, one in zip(ids, first, strict=True)]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("own"), *(pa.array(x, pa.int64()) for x in more)], names=["row", "doc_id", "n_words", "n_features", "weight", "noise"])

    each = parts.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long, noise long")
    return each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight", "noise")))


def ranked(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """``rows`` (row, doc_id, n_words, score, ...) with rank: the place by score of the best ``percent`` of those with ``least`` words, null for others.

    Rows are sorted over ranges and written; a row's rank is its place in its range and the number of rows in earlier ones.
    """
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    flat = rows.withColumn("fit", F.col("n_words") >= least).repartitionByRange(*order).sortWithinPartitions(*order)
    flat = written(flat.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, start, fit = [], 0, 0
    for r in flat.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fit")).orderBy("part").collect():  # a row per range
        before.append((r["part"], start))
        start, fit = start + r["n"], fit + r["fit"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + within + 1
    return flat.withColumn("part", part.cast("long")).join(starts, "part").withColumn("rank", F.when(F.col("fit") & (rank <= percent * fit // 100), rank)).drop("part", "before", "place", "fit")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs`` (doc_id, text), by how far its features tell ``target`` (text) from all of ``docs``.

    Nulls: a null text has no words; a null doc_id is kept, draws its noise as empty text and comes last among equal scores.
    A text without words has no features and weight 0, and like any of fewer than ``least`` words is not drawn. Repeated
    rows are documents of their own and count as often in all sums; they have equal scores, and ranks one after another.
    Ties go to the smaller doc_id. An empty ``docs`` gives no rows; an empty ``target`` has one of each bucket. Other columns are ignored.
    """
    parts = chunks(docs)
    gain = gains(feature_counts(parts), feature_counts(chunks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))))
    scored = weighed(parts, gain, seed).withColumn("score", F.col("weight") + F.col("noise"))
    return ranked(scored, least, percent).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and the ranks of the drawn ones."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
