"""Hashed linear models: features of whole texts by vectorised hashing, FTRL-proximal training, scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import NOT_SPACE, WORD_BYTES, mix, short_batches, slices, text_buffers, word_hashes

_A, _B, _C, _S = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB))


def _shapes() -> np.ndarray:
    """Bytes by kind: capitals, other letters, digits; all others as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91], t[97:123], t[128:], t[48:58] = 65, 97, 97, 48
    return t


SHAPE = _shapes()


def gram_features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their texts' numbers: words, pairs, triples and pairs that skip one word."""
    h, first = word_hashes(data, off, WORD_BYTES)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    feats, owns = [mix(h ^ _S)], [own]
    for gap, salt in ((1, _A), (2, _C)):
        if len(h) > gap:
            feats.append(mix(h[:-gap] * salt + h[gap:] * _B))
            owns.append(np.where(own[:-gap] == own[gap:], own[:-gap], -1))
    if len(h) > 2:
        feats.append(mix(h[:-2] * _S + h[1:-1] * _A + h[2:] * _C))
        owns.append(np.where(own[:-2] == own[2:], own[:-2], -1))
    f, o = np.concatenate(feats) >> np.uint64(64 - bits), np.concatenate(owns)
    return f[o >= 0].astype(np.int64), o[o >= 0]


def shape_features(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their texts' numbers: the words' shapes, whether a word repeats the one before, and pairs of shapes."""
    h, first = word_hashes(SHAPE[data], off, NOT_SPACE)
    raw, _ = word_hashes(data, off, NOT_SPACE)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    feats, owns = [mix(h ^ _S)], [own]
    if len(h) > 1:
        same = own[:-1] == own[1:]
        feats += [mix(h[:-1] * _A + h[1:] * _B), mix(np.full(len(h) - 1, _C))]
        owns += [np.where(same, own[:-1], -1), np.where(same & (raw[:-1] == raw[1:]), own[:-1], -1)]
    f, o = np.concatenate(feats) >> np.uint64(64 - bits), np.concatenate(owns)
    return f[o >= 0].astype(np.int64), o[o >= 0]


class Ftrl:
    """FTRL-proximal logistic regression on sets of features: rates by coordinate, weights that L1 keeps at zero."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        l1 = np.full(len(z), self.l1)
        if isinstance(at, slice) or len(at):
            l1[-1] = 0  # the last is the bias
        return -np.where(np.abs(z) > l1, z - np.sign(z) * l1, 0) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, features: np.ndarray, label: float) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def trained(rows: DataFrame, features, bits: int = 20, epochs: int = 3, alpha: float = 0.6, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, label=None) -> tuple[np.ndarray, np.ndarray]:
    """The weights that are not zero, as feature numbers (the bias is 1 << bits) and values, from rows (text, label) in their order.

    With ``label``, labels are what this function says of texts' bytes and bounds, and rows have a text only. ``rows`` must be
    bounded: one task learns them one after another. What comes to the driver is at most 2**bits + 1 weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(bits, alpha, beta, l1, l2), []
        for part in slices(batches, 0):
            data, off = text_buffers(part.column(0))
            f, o = features(data, off, bits)
            both = np.unique(o << bits | f)
            cut = np.searchsorted(both >> bits, np.arange(part.num_rows + 1))
            low = (both & ((1 << bits) - 1)).astype(np.int32)
            given = label(data, off).tolist() if label else part.column(1).to_pylist()
            seen += [(low[a:b], y) for a, b, y in zip(cut[:-1], cut[1:], given, strict=True)]
        for _ in range(epochs):
            for f, y in seen:
                model.learn(f, y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["at", "w"])

    short_batches(rows.sparkSession)
    got = rows.select("text", *([] if label else [F.col("label").cast("double")])).mapInArrow(run, "at long, w double").toArrow()
    at, w = got.column("at").to_numpy(), got.column("w").to_numpy()
    order = np.argsort(at)
    return at[order], w[order]


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], features, bits: int = 20, text: str = "text", keep_text: bool = False, also=None, kinds: str = "") -> DataFrame:
    """The columns of ``docs``, ``text`` only with ``keep_text``, and ``score``, the probability of label 1 by the whole text.

    ``also`` makes more columns, which ``kinds`` declares, of texts' bytes and bounds. A text goes to a worker once.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))
    rest = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << bits) + 1, np.float32)
        w[shared.value[0]] = shared.value[1]
        bias = float(w[-1])
        for part in slices(batches, text):
            data, off = text_buffers(part.column(text))
            f, o = features(data, off, bits)
            on = np.flatnonzero(w[f])
            both = np.unique(o[on] << bits | f[on])
            s = np.bincount(both >> bits, w[both & ((1 << bits) - 1)], part.num_rows) + bias
            more = also(data, off) if also else {}
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30)))), *more.values()], names=[*rest, "score", *more])

    short_batches(docs.sparkSession)
    fields = [StructField(f.name, f.dataType) for f in docs.schema.fields if f.name in rest] + [StructField("score", DoubleType())]
    return docs.mapInArrow(run, StructType(fields + (StructType.fromDDL(kinds).fields if kinds else [])))
