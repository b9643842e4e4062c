"""Log-probabilities of texts by a hashed maximum-entropy model with a class-factored softmax.

A token is predicted in three steps: its outcome's class, its outcome within the class, its word within the outcome. An
outcome is the end of a text, one of the ``OWN`` most frequent words, or one of ``SUFFIXES`` buckets of all other words by
their last bytes. The first two steps are softmaxes over sums of weights of the words before: each of the last three (two
of them skip words) and, hashed, the last two together. Within a bucket, known words share by their counts, and as much is
left for unknown words as words seen once take there. So probabilities of the training words and of unknown ones add up to 1.

Counts of all words are exact and stay distributed; only the ``KNOWN`` most frequent are broadcast, so no word that is
joined can be more than 1 / KNOWN of all tokens. The model's size does not grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.tables import written

from .shared import ASCII_LOWER, NOT_SPACE, mix, null_safe_text, release, short_batches, slices, text_buffers, word_hashes

#: Outcomes: the end, words of their own, and buckets of the others; as classes of equal size.
OWN, SUFFIXES, WIDTH = 575, 448, 32
OUTCOMES = 1 + OWN + SUFFIXES  # WIDTH classes of WIDTH members
#: Words of which counts are broadcast. Rows of the hashed weight tables. Neighbours by which outcomes are put into classes.
KNOWN, HASHED, ANCHORS = 1 << 18, 1 << 13, 64
#: Rounds of training, each over its share of the texts; tokens that are taken at a time; rows of a block of sums that is sent.
ROUNDS, STEP, BLOCK = 4, 1 << 15, 512
#: What the first round moves weights by, of the logarithm of observed over expected counts, how that falls, and how many expected ones are added to both.
RATE, DECAY, PRIOR = 0.5, 0.5, 2.0
#: The end's key; a word's key has its suffix bucket in the last 9 bits.
END = 0
_WINDOW = 1 << 20


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive texts, in windows of bounded memory."""
    n, starts, ends = len(data), [], []
    for lo in range(0, n, _WINDOW):
        hi = min(n, lo + _WINDOW)
        inside = NOT_SPACE[data[lo:hi]]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[0], after[-1] = lo > 0 and NOT_SPACE[data[lo - 1]], hi < n and NOT_SPACE[data[hi]]
        edge = off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo
        before[edge] = False
        edge = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, hi, "right")] - lo - 1
        after[edge] = False
        starts.append(np.flatnonzero(inside & ~before) + lo)
        ends.append(np.flatnonzero(inside & ~after) + lo + 1)
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of each word, and for each text the index of its first word."""
    h, first = word_hashes(data, off, NOT_SPACE)
    start, end = _spans(data, off)
    tail = np.zeros(len(h), np.uint64)
    for k in (1, 2, 3):
        at = end - k
        tail = tail << np.uint64(8) | np.where(at >= start, ASCII_LOWER[data[np.maximum(at, 0)]], 0).astype(np.uint64)
    key = h & np.uint64(~511 & ((1 << 64) - 1)) | mix(tail + np.uint64(1)) % np.uint64(SUFFIXES)
    return np.where(key == 0, np.uint64(512), key).view(np.int64), first


def word_counts(rows: DataFrame) -> DataFrame:
    """key, train and all_: how often each word, and the end, is in the texts that are not held out, and in all. Counted in slices, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            data, off = text_buffers(part.column(1))
            key, first = word_keys(data, off)
            train = ~part.column(0).to_numpy(zero_copy_only=False)
            found, at = np.unique(key, return_inverse=True)
            own = np.repeat(train, np.diff(first))
            n = [np.append(np.bincount(at[own], minlength=len(found)), train.sum()), np.append(np.bincount(at, minlength=len(found)), len(train))]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, END)), *map(pa.array, n)], names=["key", "train", "all_"])

    return rows.select("held_out", "text").mapInArrow(run, "key long, train long, all_ long").groupBy("key").agg(F.sum("train").alias("train"), F.sum("all_").alias("all_"))


class Vocabulary:
    """What tasks know of words: keys in order, counts and outcomes of the ``KNOWN`` most frequent, and what is left in each bucket."""

    def __init__(self, words: DataFrame) -> None:
        rest = words.filter(F.col("key") != END)
        self.docs = words.filter(F.col("key") == END).agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
        per = rest.groupBy(F.col("key").bitwiseAND(511).cast("int").alias("b")).agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v"), F.count_if(F.col("train") == 1).alias("once")).collect()  # a row a bucket
        n, v, once = (np.zeros(512, np.int64) for _ in range(3))
        for r in per:
            n[r["b"]], v[r["b"]], once[r["b"]] = r["n"], r["v"], r["once"]
        self.tokens, self.types = int(n.sum()) + self.docs, int(v.sum()) + (self.docs > 0)
        top = rest.orderBy(F.col("all_").desc(), "key").limit(KNOWN).select("key", "train").toArrow()
        key, train = top.column("key").to_numpy(), top.column("train").to_numpy()
        own = np.flatnonzero(train > 0)[:OWN]
        outcome = (1 + OWN + (key & 511)).astype(np.uint16)
        outcome[own] = np.arange(1, len(own) + 1)
        np.subtract.at(n, key[own] & 511, train[own])
        np.subtract.at(v, key[own] & 511, 1)
        np.subtract.at(once, key[own] & 511, (train[own] == 1).astype(np.int64))
        #: The share of unknown words in each bucket, and log10 of what a known word's count + 0.5 is multiplied with.
        self.unknown = np.where(v > 0, (once + 0.5) / (n + 1.0), 1.0)
        self.known = np.log10(np.where(v > 0, (1 - np.minimum(self.unknown, 1 - 1e-9)) / np.maximum(n + 0.5 * v, 0.5), 1.0))
        order = np.argsort(key)
        self.key, self.train, self.outcome = key[order], train[order], outcome[order]


def encoded(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """Each row's outcomes (``ids``: 2 bytes a token), what its frequent words and its end contribute, and keys and times of its other words."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        end_base = math.log10(voc.docs + 0.5)
        lu = np.log10(voc.unknown)
        for part in slices(batches, 3):
            data, off = text_buffers(part.column(3))
            key, first = word_keys(data, off)
            n, docs = np.diff(first), part.num_rows
            found, at = np.unique(key, return_inverse=True)
            place = np.minimum(np.searchsorted(voc.key, found), max(0, len(voc.key) - 1))
            hit = voc.key[place] == found if len(voc.key) else np.zeros(len(found), bool)
            bucket = found & 511
            count = np.where(hit, voc.train[place] if len(voc.key) else 0, 0)
            outcome = np.where(hit, voc.outcome[place] if len(voc.key) else 0, 1 + OWN + bucket)
            base = np.where(hit, np.log10(count + 0.5), 0)
            within = np.where(hit & (outcome > OWN), np.where(count > 0, np.log10(np.maximum(count, 1) + 0.5) + voc.known[bucket], lu[bucket]), 0)
            own = np.repeat(np.arange(docs), n)
            ids = np.zeros(len(key) + docs, "<u2")
            ids[np.arange(len(key)) + own] = outcome[at]
            sums = [np.bincount(own, x[at], docs).astype(float) for x in ((hit & (count > 0)).astype(float), base, within)]
            far = np.flatnonzero(~hit[at])
            o = far[np.lexsort((at[far], own[far]))]
            new = np.flatnonzero(np.diff(own[o], prepend=-1).astype(bool) | np.diff(at[o], prepend=-1).astype(bool))
            times = np.diff(np.append(new, len(o)))
            lists = np.searchsorted(own[o[new]], np.arange(docs + 1)).astype(np.int32)
            cut = np.append(first, 0)[: docs + 1] + np.arange(docs + 1)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), part.column(2), pa.array(n + 1), pa.array(sums[0].astype(np.int64) + (voc.docs > 0)), pa.array(sums[1] + end_base), pa.array(sums[2]),
                pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(lists), pa.array(found[at[o[new]]])), pa.ListArray.from_arrays(pa.array(lists), pa.array(times)),
            ], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "ids", "keys", "times"])

    return rows.select("row", "doc_id", "held_out", "text").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, ids binary, keys array<long>, times array<long>")


def _tokens(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their outcomes, about STEP tokens at a time; a longer text comes whole."""
    for batch in batches:
        size = np.cumsum([len(x.as_buffer()) // 2 for x in batch.column(column)])
        lo, before = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, before + STEP, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in part.column(column)])
            lo, before = hi, size[hi - 1]


def neighbour_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each outcome occurs, and how often next to each of the first ``ANCHORS``, before and behind."""
    width = 2 * ANCHORS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(OUTCOMES * width, np.int64)
        for _, ids in _tokens(batches, 0):
            x = ids.astype(np.int64)
            before, behind = x[:-1] < ANCHORS, x[1:] < ANCHORS
            for at in (x[1:][before] * width + x[:-1][before], x[:-1][behind] * width + ANCHORS + x[1:][behind], x * width + 2 * ANCHORS):
                np.add.at(total, at, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = texts.select("ids").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # OUTCOMES * width rows at most
    m = np.zeros(OUTCOMES * width)
    m[got.column("at").to_numpy()] = got.column("n").to_numpy()
    m = m.reshape(OUTCOMES, width)
    return m[:, -1], m[:, :-1]


def classes(near: np.ndarray) -> np.ndarray:
    """A place for each outcome, class * WIDTH + member: outcomes with like neighbours share a class. Sets are halved along their principal direction."""
    x = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    sets = [np.arange(len(x))]
    while len(sets) < WIDTH:
        halves = []
        for own in sets:
            y = x[own] - x[own].mean(axis=0)
            way = np.linalg.svd(y, full_matrices=False)[2][0]
            way *= np.sign(way[np.abs(way).argmax()]) or 1
            order = own[np.argsort(y @ way, kind="stable")]
            halves += [order[: len(own) // 2], order[len(own) // 2 :]]
        sets = halves
    place = np.empty(len(x), np.int64)
    place[np.concatenate(sets)] = np.arange(len(x))
    return place


class Model:
    """Weights of the features, a row of WIDTH for each, and biases. The first tables tell classes, the last two, hashed with the class, members."""

    STARTS = (0, OUTCOMES, 2 * OUTCOMES, 3 * OUTCOMES, 3 * OUTCOMES + HASHED, 3 * OUTCOMES + 2 * HASHED)
    ROWS = 3 * OUTCOMES + 3 * HASHED

    def __init__(self, place: np.ndarray, counts: np.ndarray) -> None:
        self.place = place
        both = np.empty(OUTCOMES)
        both[place] = counts + 0.5
        both = both.reshape(WIDTH, WIDTH)
        self.of_class = np.log(both.sum(axis=1) / both.sum()).astype(np.float32)
        self.of_member = np.log(both / both.sum(axis=1, keepdims=True)).astype(np.float32)
        self.w = np.zeros((self.ROWS, WIDTH), np.float32)

    def predicted(self, ids: np.ndarray) -> list[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """For classes, then members: the rows of each feature, probabilities, and which of them came. A text's first tokens have ends before them."""
        ids = ids.astype(np.int64)
        before = [np.append(END, ids[:-1])]
        for _ in range(2):
            last = before[-1]
            before.append(np.where(last == END, END, np.append(END, last[:-1])))
        kind, member = np.divmod(self.place[ids], WIDTH)
        hashed = lambda x: (x.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - HASHED.bit_length() + 1)).astype(np.int64)
        rows = [before[0], before[1], before[2], hashed(before[0] * OUTCOMES + before[1]), hashed(before[0] * WIDTH + kind), hashed(before[1] * WIDTH + kind)]
        rows = [(r + start).astype(np.uint16) for r, start in zip(rows, self.STARTS, strict=True)]
        return [(rows[:4], self._softmax(rows[:4], self.of_class), kind), (rows[4:], self._softmax(rows[4:], self.of_member[kind]), member)]

    def _softmax(self, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
        x = self.w[rows[0]]
        for r in rows[1:]:
            x += self.w[r]
        x += bias
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    def moved(self, observed: np.ndarray, expected: np.ndarray, rate: float) -> None:
        """A step up the gradient (observed less expected counts), scaled for each weight: by the ratio of the two, so that rare features move too, and no further than ``PRIOR`` lets them."""
        prior = PRIOR * expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-9) + 1e-9
        self.w += (rate * np.log((observed + prior) / (expected + prior))).astype(np.float32)


def gradient(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected counts of all weights over the texts. Tasks send sums by blocks of rows, which are added up as they come in."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    shape = (2, BLOCK, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        observed, expected = np.zeros(m.ROWS * WIDTH, np.float32), np.zeros((m.ROWS, WIDTH), np.float32)
        for _, ids in _tokens(batches, 0):
            for rows, p, came in m.predicted(ids):
                for r in rows:
                    np.add.at(observed, r.astype(np.int64) * WIDTH + came, np.float32(1))
                    o = np.argsort(r, kind="stable")
                    first = np.flatnonzero(np.diff(r[o].astype(np.int64), prepend=-1))
                    expected[r[o[first]]] += np.add.reduceat(p[o], first, axis=0)
        sums = np.stack([observed.reshape(expected.shape), expected], axis=1).reshape(-1, BLOCK, 2, WIDTH)
        at = np.flatnonzero(sums.any(axis=(1, 2, 3)))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([sums[i].swapaxes(0, 1).tobytes() for i in at], pa.binary())], names=["block", "sums"])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(sums.as_buffer(), np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])

    kinds = "block int, sums binary"
    got = texts.select("ids").mapInArrow(run, kinds).repartition("block").mapInArrow(add, kinds).toArrow()  # a row a block
    out = np.zeros((model.ROWS // BLOCK, *shape))
    for at, sums in zip(got.column("block").to_pylist(), got.column("sums"), strict=True):
        out[at] = np.frombuffer(sums.as_buffer(), np.float64).reshape(shape)
    return out[:, 0].reshape(model.ROWS, WIDTH), out[:, 1].reshape(model.ROWS, WIDTH)


def trained(texts: DataFrame, rounds: int | None = None) -> Model:
    """The model of texts (row, ids): each round moves the weights by its share of the texts, so all of them are learnt from once. Later rounds move less."""
    rounds = rounds or ROUNDS
    tasks = 2 * texts.sparkSession.sparkContext.defaultParallelism  # a task sends sums as large as the model, so there are few
    counts, near = neighbour_counts(texts.coalesce(tasks))
    model = Model(classes(near), counts)
    for at in range(rounds):
        model.moved(*gradient(texts.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == at).coalesce(tasks), model), RATE / (1 + DECAY * at))
    return model


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """The columns of ``texts`` without ids, and log_p: log10 of the probability of each text's outcomes."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in texts.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, ids in _tokens(batches, len(kept)):
            logs = sum(np.log10(np.maximum(p[np.arange(len(ids)), came], 1e-30).astype(np.float64)) for _, p, came in m.predicted(ids))
            end = np.flatnonzero(ids == END)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(np.add.reduceat(logs, np.append(0, end[:-1] + 1)))], names=[*kept, "log_p"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in kept]
    return texts.select(*kept, "ids").mapInArrow(run, ", ".join([*fields, "log_p double"]))


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of (doc_id, text).

    The model and the counts are of the rows that are not held out. Nulls: a null text is empty and has the end alone; a null
    doc_id is kept and not held out. Repeated rows come back, and count, as often. A word that training lacks has the
    probability of its bucket's unknown words. Without training rows the base score is 0 and all outcomes are alike. An
    empty table gives no rows. Other columns are ignored.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), null_safe_text().alias("text"))
    words = written(word_counts(rows), "words")
    voc = Vocabulary(words)
    texts = written(encoded(rows, voc), "encoded")
    model = trained(texts.filter(~F.col("held_out")).select("row", "ids"))
    near = scored(texts.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "ids"), model)
    far = texts.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("row", F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    c, bucket = F.coalesce("train", F.lit(0)), F.col("key").bitwiseAND(511).cast("int")
    of = lambda x: F.get(F.lit([float(v) for v in x]), bucket)
    log_c = F.log10(c + 0.5)
    far = far.join(words.select("key", "train"), "key", "left").select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(0).alias("n_tokens"), F.when(c > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * log_c).alias("base"), (F.col("times") * F.when(c > 0, log_c + of(voc.known)).otherwise(of(np.log10(voc.unknown)))).alias("within"), F.lit(0.0).alias("log_p"),
    )
    total = near.unionByName(far).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "within", "log_p")))
    z = math.log10(voc.tokens + 0.5 * (voc.types + 1))
    return total.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(voc.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * z).alias("base_score"), (F.col("log_p") + F.col("within")).alias("score"),
    )


def op11_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's log-probability by unigrams and by the model of the documents that are not held out."""
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
