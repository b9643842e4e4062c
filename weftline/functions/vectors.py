"""Vectors as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

VECTOR = "array<double>"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def numbers(raw: Column) -> Column:
    """A vector of numbers from JSON text, a bare list or {"data": list}; entries that are no numbers are dropped; null if none is left."""
    items = F.coalesce(F.from_json(F.get_json_object(raw, "$.data"), "array<string>"), F.from_json(raw, "array<string>"))
    v = F.filter(F.transform(items, lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(v) > 0, v)


def coerced(df: DataFrame, name: str = "embedding") -> Column:
    """The numbers of an embedding column: an array, a struct with ``data``, or JSON text. Entries that are no finite numbers are dropped; null if none is left."""
    kind, raw = df.schema[name].dataType, F.col(name)
    if isinstance(kind, StructType):
        kind, raw = kind["data"].dataType, raw["data"]
    v = numbers(raw) if isinstance(kind, StringType) else F.transform(raw, lambda x: x.try_cast("double"))
    v = F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.size(v) > 0, v)


def padded(v: Column, dim: Column) -> Column:
    """A vector with zeros up to ``dim`` components."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(dim - F.size(v), F.lit(0))))


def dot(a: Column, b: Column) -> Column:
    """The inner product over the shorter length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x)


def unit(v: Column) -> Column:
    """A vector of length one, or the zeros it consists of."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    over = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))
    return let(v.cast(VECTOR), lambda v: let(norm(v), lambda n: over(v, n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))


def _char_sums(dim: int):
    """A function of a text column: for each component the sum of what its characters add, by whole arrays of code points."""

    def sums(texts: pd.Series) -> pd.Series:
        import numpy as np

        def one(t: str | None):
            c = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            h = (c * np.uint64(1315423911) + np.arange(len(c), dtype=np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)
            return np.bincount((h % np.uint64(dim)).astype(np.int64), ((h >> np.uint64(24)) & np.uint64(255)).astype(float) - 128, dim)

        return texts.map(one)

    return F.pandas_udf(sums, VECTOR)


def char_hash(text: Column, dim: int = 64) -> Column:
    """An embedding by characters: each adds a number between -128 and 127 to one component, both from a hash of the character and its place. Length one, 6 decimals."""
    return F.transform(unit(_char_sums(dim)(text)), lambda x: F.round(x, 6))


EMBEDDERS = {"char": char_hash, "hash": lambda text, dim=64: seeded_normal(dim)(text)}


def embedder(name: str = "hash64", dim: int | str | None = None):
    """(function of a text column, dimensions) by name: char or hash, with the dimensions behind it or as ``dim``, which comes first; else 64. An unknown name is hash64."""
    found = re.fullmatch(r"(char|hash)(\d*)", name.strip().lower())
    kind, behind = found.groups() if found else ("hash", "")
    try:
        n = max(1, int(dim)) if dim not in (None, "") else max(1, int(behind or 64))
    except ValueError:
        n = 64
    return (lambda text: EMBEDDERS[kind](text, n)), n


def seeded_normal(dim: int = 64):
    """A function of a text column: a unit vector of normal deviates, seeded by the first 4 bytes of the text's MD5."""

    def embed(texts: pd.Series) -> pd.Series:
        import hashlib

        import numpy as np

        def one(t: str | None):
            seed = int.from_bytes(hashlib.md5((t or "").encode()).digest()[:4], "big")
            v = np.random.RandomState(seed).normal(size=dim).astype(np.float32)
            n = float(np.linalg.norm(v))
            return v / n if n else v

        return texts.map(one)

    return F.pandas_udf(embed, "array<float>")
