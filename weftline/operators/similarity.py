"""Similarity joins of unit vectors: internal-link suggestions and retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.functions import urls, vectors
from weftline.operators.clustering import Vectors
from weftline.plans.tables import written

#: Targets that are broadcast at a time, and bytes of their vectors; sources of one product.
TARGET_BLOCK, TARGET_BYTES, SOURCE_BLOCK = 16_384, 1 << 25, 512


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def link_suggestions(items: DataFrame, per_item: int = 5, min_sim: float = 0.45, exclude: str | None = None, fallback: bool = False) -> DataFrame:
    """For each item its most similar others by cosine: source_id, target_id, source_url, target_url, similarity (6 decimals).

    Pairs of one path, homepages as targets and paths that ``exclude`` finds are left out. At most ``per_item`` targets of
    at least ``min_sim``; with ``fallback``, an item that has none gets its best whatever they reach. Ties go to the
    smaller target id. Items have id, url and embedding, as ``clustering.Vectors`` takes them; those without a vector take no
    part, a null url counts as an empty one, and items that share an id are items of their own.

    Targets go out in blocks of bounded rows and bytes, one after another, and a partition of sources keeps its best per
    block, so all pairs are scored but none is a row.
    """
    on = Vectors(items, keep=("url",)).df.withColumn("at", F.coalesce("url", F.lit(""))).withColumns({"path": urls.path(F.col("at")), "home": urls.is_homepage(F.col("at"))}).drop("at")
    on = on.filter(~urls.matches(F.col("path"), exclude))
    targets = on.filter(~F.col("home")).select("row", "path", "u")
    n, dim = targets.agg(F.count(F.lit(1)), F.max(F.size("u"))).first()
    most = max(1, min(TARGET_BLOCK, TARGET_BYTES // (8 * (dim or 1))))
    blocks = max(1, -(-n // most) * (1 if n <= most else 2))
    out = None
    for b in range(blocks):
        got = targets.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").toArrow()
        if not got.num_rows:
            continue
        best = _best(on.select("row", "path", "u"), got, per_item)
        best = written(best, "best") if blocks > 1 else best
        out = best if out is None else out.union(best)
    if out is None:
        return items.sparkSession.createDataFrame([], "source_id long, target_id long, source_url string, target_url string, similarity double")
    return chosen(out, on.select("row", "id", "url"), per_item, min_sim, fallback)


def chosen(pairs: DataFrame, names: DataFrame, per_item: int, min_sim: float, fallback: bool) -> DataFrame:
    """The best pairs (source, target, similarity) of each source by the rules of ``link_suggestions``, with ids and urls of their rows."""
    place = F.row_number().over(W.partitionBy("source").orderBy(F.col("similarity").desc(), "target"))
    top = pairs.withColumn("place", place).filter(F.col("place") <= per_item)
    if fallback:
        top = top.withColumn("most", F.max("similarity").over(W.partitionBy("source"))).filter((F.col("similarity") >= min_sim) | (F.col("most") < min_sim))
    else:
        top = top.filter(F.col("similarity") >= min_sim)
    for side in ("source", "target"):
        top = top.join(names.withColumnsRenamed({"row": side, "id": f"{side}_id", "url": f"{side}_url"}), side)
    return top.select("source_id", "target_id", "source_url", "target_url", "similarity")


def _best(sources: DataFrame, targets: pa.Table, k: int) -> DataFrame:
    ids = targets.column("row").to_numpy()
    paths = targets.column("path").to_numpy(zero_copy_only=False)
    shared = sources.sparkSession.sparkContext.broadcast((ids, paths, np.ascontiguousarray(_matrix(targets.column("u").combine_chunks()).T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, paths, matrix = shared.value
        at = {}
        for i, p in enumerate(paths):
            at.setdefault(p, []).append(i)
        for batch in batches:
            for lo in range(0, batch.num_rows, SOURCE_BLOCK):
                t = batch.slice(lo, SOURCE_BLOCK)
                own = t.column(0).to_numpy()
                sims = np.round(_matrix(t.column(2)) @ matrix, 6)
                for i, p in enumerate(t.column(1).to_pylist()):
                    sims[i, at.get(p, [])] = -9
                rows, cols = [], []
                for i, row in enumerate(sims):
                    bound = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -2
                    some = np.flatnonzero((row >= bound) & (row > -2))
                    some = some[np.lexsort((ids[some], -row[some]))][:k]
                    rows.append(np.full(len(some), i))
                    cols.append(some)
                r, c = np.concatenate(rows), np.concatenate(cols)
                yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(ids[c]), pa.array(sims[r, c])], names=["source", "target", "similarity"])

    return sources.mapInArrow(run, "source long, target long, similarity double")


def retrieve(docs: DataFrame, query: str, k: int = 5, site: str | None = None, dim: int = 64, filters: dict | None = None) -> DataFrame:
    """The ``k`` documents (id, url, title, text) nearest to a query by character-hash embeddings: with score (6 decimals).

    ``docs`` may be an index that has embeddings. ``site`` is part of the url; ``filters`` are values of columns, and one
    of a column that is not there matches nothing.
    """
    q = F.lit(docs.sparkSession.range(1).select(vectors.char_hash(F.lit(query), dim)).first()[0])
    some = docs.filter(F.col("url").contains(site)) if site else docs
    for name, value in (filters or {}).items():
        some = some.filter(F.col(name) == value if name in docs.columns else F.lit(False))
    own = F.col("embedding") if "embedding" in docs.columns else vectors.char_hash(F.col("text"), dim)
    return some.withColumn("score", F.round(vectors.cosine(own, q), 6)).orderBy(F.col("score").desc(), "id").limit(max(0, k))
