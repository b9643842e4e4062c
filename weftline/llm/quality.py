"""Quality from weak labels: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer of the posterior labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import scored, shape_features, trained
from .shared import NOT_SPACE, null_safe_text, short_batches, slices, text_buffers, word_hashes

#: The most documents on which the scorer is fitted: those of the smallest hash of text and doc_id.
TRAIN_ROWS = 12_000
#: Labellers: name, a share of a text, and the bounds: a text votes bad (0) beyond the first, good (1) short of the
#: second, and abstains (-) between them.
LABELLERS = {
    "symbols": (0.13, 0.06), "bars": (0.15, 0.02), "capitals": (0.35, 0.12), "repeats": (0.12, 0.03),
    "marked": (0.30, 0.16), "long_words": (0.75, 0.50), "few_stops": (0.60, 0.30), "one_word": (0.30, 0.20),
}
LEAST_WORDS, BITS = 8, 18


def shares(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text the labellers' shares, one column each, and the number of words as the last."""
    cut = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[off]) if len(flags) else np.zeros(len(off) - 1)
    cut_at = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    inside = NOT_SPACE[data]
    symbol = inside & ~letter & ~((data >= 48) & (data <= 57))
    letters, chars = cut(letter), cut(inside)
    h, first = word_hashes(data, off, NOT_SPACE)
    n = np.diff(first)
    own = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    # words' ends, for marks after words and for lengths
    end = inside.copy()
    if len(end):
        end[:-1] &= ~inside[1:]
        b = off[1:]
        b = b[b > 0] - 1
        end[b] |= inside[b]
    start = inside.copy()
    if len(start):
        start[1:] &= ~inside[:-1]
        b = off[:-1]
        b = b[b < len(inside)]
        start[b] |= inside[b]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    marked = symbol[e] & (data[e] != 46) & (data[e] != 44)
    stops = (data[e] == 46) | (data[e] == 44)
    per = lambda flags: np.diff(cut_at(flags)[first])
    most = np.zeros(len(n))
    if len(h):
        both = np.lexsort((h, own))
        new = np.ones(len(h), bool)
        new[1:] = (h[both][1:] != h[both][:-1]) | (own[both][1:] != own[both][:-1])
        at = np.flatnonzero(new)
        np.maximum.at(most, own[both][at], np.diff(np.append(at, len(h))))
    w = np.maximum(n, 1)
    return np.column_stack((
        cut(symbol) / np.maximum(chars, 1), per(data[s] == 124) / w, cut(upper) / np.maximum(letters, 1), per(same) / w,
        per(marked) / w, per(e - s >= 6) / w, 1 - np.minimum(1, 8 * per(stops) / w), most / w, n,
    ))


def votes_of(data: np.ndarray, off: np.ndarray) -> list[str]:
    """The labellers' votes on each text, a character per labeller."""
    bad, good = np.array(list(LABELLERS.values())).T
    x = shares(data, off)
    v = np.where(x[:, :-1] > bad, ord("0"), np.where(x[:, :-1] < good, ord("1"), ord("-"))).astype(np.uint8)
    v[x[:, -1] < LEAST_WORDS] = ord("-")
    return [bytes(r).decode() for r in v]


def votes(texts: DataFrame) -> DataFrame:
    """``votes`` of each text of a table of one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(votes_of(*text_buffers(part.column(0))), pa.string())], names=["votes"])

    short_batches(texts.sparkSession)
    return texts.mapInArrow(run, "votes string")


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """P(good) of each vote pattern, by a mixture of two classes in which each labeller votes on its own.

    Rates of each labeller's votes by class, and the classes' shares, are estimated from all patterns with their counts.
    An abstention says nothing. A pattern begins the more likely bad the more bad votes it has, which also says which
    class is which.
    """
    v = np.array([[".01-".index(c) - 1 for c in p] for p in patterns]).reshape(len(patterns), -1)
    p = 0.9 * 0.4 ** (v == 0).sum(1)
    for _ in range(rounds):
        log = np.zeros((len(v), 2))
        for c, q in ((0, 1 - p), (1, p)):
            mass = counts * q
            log[:, c] = np.log((mass.sum() + 1) / (counts.sum() + 2))
            for k in range(v.shape[1]):
                rate = np.bincount(v[:, k], mass, 3)[:2] + 1
                log[:, c] += np.append(np.log(rate / rate.sum()), 0)[v[:, k]]
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return p


def quality(docs: DataFrame, rows: int = TRAIN_ROWS, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, votes, weak (P(good) by the votes alone), score (by the scorer) and keep (score >= threshold) for each row.

    Votes of all documents are counted by pattern, of which there are at most 3**8, and these counts fit the labellers'
    accuracies. The scorer is fitted on about ``rows`` documents, those of the smallest hash of text and doc_id, by their posterior labels.

    Nulls: a null text is empty; a null doc_id is kept. Texts of fewer than 8 words get no votes; an empty one scores as
    the bias says. Repeated rows come back as often; ties cannot matter, as all depends on the text only. An empty table
    gives no rows. Other columns are ignored.
    """
    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), null_safe_text(text).alias("text"))
    seen = votes(rows_in.select("text")).groupBy("votes").count().orderBy("votes").toArrow()
    patterns, counts = seen.column("votes").to_pylist(), seen.column("count").to_numpy().astype(float)
    weak = dict(zip(patterns, expectation_maximisation(patterns, counts).tolist(), strict=True)) if patterns else {}
    posterior = lambda found: np.array([weak.get(v, 0.5) for v in found])
    # a share of the hash's range that holds about that many rows, so that no more than these meet in the task that learns
    share = int(min(1.0, 1.1 * rows / max(counts.sum(), 1)) * (1 << 32))
    few = rows_in.withColumn("h", F.xxhash64("text", "doc_id")).filter(F.shiftrightunsigned("h", 32) < share).orderBy(F.shiftrightunsigned("h", 32), "h", "doc_id").limit(rows)
    model = trained(few.select("text"), shape_features, BITS, epochs=2, l1=1.0, label=lambda data, off: posterior(votes_of(data, off)))

    def told(data: np.ndarray, off: np.ndarray) -> dict:
        found = votes_of(data, off)
        return {"votes": pa.array(found, pa.string()), "weak": pa.array(posterior(found))}

    score = scored(rows_in, model, shape_features, BITS, also=told, kinds="votes string, weak double")
    return score.select("doc_id", "votes", "weak", "score", (F.col("score") >= threshold).alias("keep"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's votes, score and decision."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
