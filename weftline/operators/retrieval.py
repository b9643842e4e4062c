"""A stored index for retrieval: texts by cells of their embeddings, of which a query reads those that can hold its best."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import NotFound
from weftline.functions import vectors
from weftline.operators import cells
from weftline.operators.similarity import retrieve
from weftline.operators.store import one_per_key
from weftline.plans.tables import current, dropped, replaced, written

#: The part of a store that lists its cells: their centres, what is farthest from each, and their rows.
DIRECTORY = -1
#: Columns of a store besides those of its documents.
OWN = ("cell", "cell_of", "cell_far", "cell_rows")
#: What scores of 6 decimals and unit vectors of rounded components can be off by.
SLACK = 2e-6


def _place(embedding: Column, middles: np.ndarray, spark: SparkSession) -> Column:
    """The nearest centre of an embedding's unit vector, and the distance to it."""
    shared = spark.sparkContext.broadcast(middles)  # cells.MOST_CELLS rows at most

    def place(embedding: pd.Series) -> pd.DataFrame:
        cell, far = np.zeros(len(embedding), np.int32), np.zeros(len(embedding))
        for lo in range(0, len(embedding), 1024):
            x = np.stack(embedding.iloc[lo : lo + 1024].to_numpy())
            norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
            at = cells._near(x, shared.value, 1)[:, 0]
            cell[lo : lo + 1024], far[lo : lo + 1024] = at, np.sqrt(((x - shared.value[at]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell, "far": far})

    return F.pandas_udf(place, "cell int, far double")(embedding)


def _stored(rows: DataFrame, middles: np.ndarray, path: str) -> str:
    """Writes rows (with embedding) and the directory of their cells as the version that counts.

    A cell is a folder. Its rows are split by ranges of hashed ids, so that a cell with a third of all rows is no hot task.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("__p", _place(F.col("embedding"), middles, spark))
    sizes = placed.groupBy(F.col("__p.cell").alias("cell")).agg(F.max("__p.far").alias("far"), F.count(F.lit(1)).alias("rows")).collect()  # a row a cell
    cell_rows = [(DIRECTORY, r["cell"], middles[r["cell"]].tolist(), r["far"], r["rows"]) for r in sizes] or [(DIRECTORY, 0, middles[0].tolist(), 0.0, 0)]
    listed = spark.createDataFrame(cell_rows, "cell int, cell_of int, embedding array<double>, cell_far double, cell_rows long")
    table = placed.withColumns({"cell": F.col("__p.cell"), "cell_far": F.col("__p.far")}).drop("__p").unionByName(listed, allowMissingColumns=True)
    return replaced(table.repartitionByRange("cell", F.xxhash64("id", "url")), path, by=("cell",))


def _embedded(docs: DataFrame, dim: int) -> DataFrame:
    """The documents, one per id, with their embeddings; written, so that texts are embedded once."""
    own = docs.drop(*OWN, "embedding")
    return written(one_per_key(own, ["id"], F.col("url")).withColumn("embedding", vectors.char_hash(F.col("text"), dim)), "embedded")


def build(docs: DataFrame, path: str, dim: int = 64, n_cells: int | None = None) -> str:
    """Stores an index of documents (id, url, text and any others) at ``path``, instead of what is there, in one step; returns its version's folder.

    One row per id stays, that of the greatest url; rows without an id count as one id. A null or empty text has a vector of zeros. Columns named as
    in ``OWN``, and embedding, are not taken over. Equal vectors count once where centres are drawn. An empty table gives an index that finds nothing.
    """
    rows = _embedded(docs, dim)
    classes = written(rows.select("id", vectors.unit(F.col("embedding")).alias("u")).groupBy("u").agg(F.min("id").alias("cls")), "classes")
    n = classes.count()
    folder = _stored(rows, cells.centres(classes, n, n_cells) if n else np.zeros((1, dim)), path)
    dropped(rows, classes)
    return folder


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, pd.DataFrame]:
    """The rows of a store, and its directory, which is a row a cell."""
    folder = current(spark, path)
    if folder is None:
        raise NotFound(f"no index at {path}")
    table = spark.read.parquet(folder)
    return table, table.filter(F.col("cell") == DIRECTORY).select("cell_of", "embedding", "cell_far", "cell_rows").orderBy("cell_of").toPandas()


def upserted(docs: DataFrame, path: str) -> str:
    """Stores the index again with ``docs`` in it, instead of the rows of their ids; without an index yet, one of them alone.

    Centres stay. Rows are written as a version beside the old one, which counts until the new one is complete, so the cost is that of the
    index, but no text is embedded again.
    """
    spark = docs.sparkSession
    if current(spark, path) is None:
        return build(docs, path)
    table, listed = _opened(spark, path)
    if not listed["cell_rows"].sum():
        return build(docs, path, len(listed["embedding"].iloc[0]))
    middles = np.array(listed["embedding"].tolist())
    new = _embedded(docs, middles.shape[1])
    old = table.filter(F.col("cell") != DIRECTORY).drop(*OWN)
    kept = old.join(new.select(F.col("id").alias("__id")), F.col("id").eqNullSafe(F.col("__id")), "left_anti")
    folder = _stored(kept.unionByName(new, allowMissingColumns=True), middles, path)
    dropped(new)
    return folder


def bounds(q: np.ndarray, centres: np.ndarray, far: np.ndarray) -> np.ndarray:
    """What scores of a query with the rows of each cell cannot exceed.

    q.x = q.c + q.(x - c) is at most q.c + far, and, as neither is longer than 1, q.x is at most 1 - |q - x|**2 / 2, where |q - x| is at least |q - c| - far.
    """
    least = np.maximum(np.sqrt(((centres - q) ** 2).sum(axis=1)) - far, 0)
    return np.minimum(centres @ q + far, 1 - least * least / 2)


def cells_for(spark: SparkSession, path: str, query: str, k: int = 5, site: str | None = None, filters: dict | None = None, probes: int = 4, exact: bool = True) -> list[int]:
    """The cells that ``search`` reads: the ``probes`` of the greatest ``bounds``; with ``exact``, all that can hold a row better than the k-th of those."""
    table, listed = _opened(spark, path)
    if k <= 0:
        return []
    middles, ids = np.array(listed["embedding"].tolist()), listed["cell_of"].to_numpy()
    q = np.array(spark.range(1).select(vectors.unit(vectors.char_hash(F.lit(query), middles.shape[1]))).first()[0])
    most = bounds(q, middles, listed["cell_far"].to_numpy())
    first = ids[np.argsort(-most, kind="stable")[: max(1, probes)]].tolist()
    if not exact:
        return first
    got = _found(table, first, query, k, site, filters, middles.shape[1]).select("score").toPandas()["score"]  # k numbers
    return ids[most >= (got.min() if len(got) == k else -np.inf) - SLACK].tolist()


def search(spark: SparkSession, path: str, query: str, k: int = 5, site: str | None = None, filters: dict | None = None, probes: int = 4, exact: bool = True) -> DataFrame:
    """As ``similarity.retrieve`` over a stored index: its rows with score, the ``k`` best first, ties to the smaller id.

    Only the folders of ``cells_for`` are opened. The result is that over all rows; with ``exact`` off it is what the first ``probes``
    cells hold. Without an index: NotFound.
    """
    table, listed = _opened(spark, path)
    dim = len(listed["embedding"].iloc[0])
    return _found(table, cells_for(spark, path, query, k, site, filters, probes, exact), query, k, site, filters, dim)


def _found(table: DataFrame, wanted: list[int], query: str, k: int, site: str | None, filters: dict | None, dim: int) -> DataFrame:
    some = table.filter(F.col("cell").isin(wanted) if wanted else F.lit(False)).drop("cell_of", "cell_far", "cell_rows")
    return retrieve(some, query, k, site, dim, filters).drop("cell", "embedding")
