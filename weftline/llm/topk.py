"""Exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.plans.tables import written

from .shared import short_batches

#: Queries that are broadcast at a time, and bytes of their vectors; more queries take more passes over the candidates.
QUERY_BLOCK, QUERY_BYTES, CANDIDATE_BLOCK, GROUP = 16_384, 1 << 25, 4096, 256


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, a long (beyond the range of longs: its end); null for a null vector and one with a null or non-finite component."""
    x = embedding.cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(x, lambda v: F.floor(scale * v).cast("long")))


def _postings(column: pa.Array, terms: int) -> np.ndarray:
    """Weights by term and vector, terms first; shorter vectors lack their last terms."""
    off = np.asarray(column.offsets)
    flat = np.asarray(column.values)[off[0] : off[-1]]
    off = off - off[0]
    sizes = np.diff(off)
    out = np.zeros((terms, len(sizes)), np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(off[:-1], sizes)
    on = at < terms
    out[at[on], own[on]] = flat[on]
    return out


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of all vectors for each query row: term after term, the query's weight times the term's postings goes into the dense score arrays.

    A term's weight of zero is skipped. Products of the integers are exact.
    """
    scores = np.zeros((len(queries), postings.shape[1]), np.int64)
    part = np.empty_like(scores)
    for term, row in enumerate(postings):
        w = queries[:, term]
        on = np.flatnonzero(w)
        if len(on) == len(w):
            np.multiply(w[:, None], row[None, :], out=part)
            scores += part
        elif len(on):
            scores[on] += w[on, None] * row[None, :]
    return scores


def select_top(scores: np.ndarray, ids: np.ndarray, k: int, but: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, positions) of each row's k highest scores in order, ties to smaller ids, without the positions that ``but`` marks.

    A partial selection finds each row's bound; only what reaches it is ordered.
    """
    on = ~but
    if scores.shape[1] > k:
        low = np.where(but, np.iinfo(np.int64).min, scores)
        at = scores.shape[1] - k
        on &= scores >= np.partition(low, at, axis=1)[:, at : at + 1]
    rows, at = np.nonzero(on)
    order = np.lexsort((ids[at], -scores[rows, at], rows))
    rows, at = rows[order], at[order]
    first = np.searchsorted(rows, rows, "left")
    best = np.arange(len(rows)) - first < k
    return rows[best], at[best]


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches together until they have ``most`` rows, larger ones in parts, as a selection costs much the same for few rows."""
    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            held.append(batch.slice(lo, most))
            n += held[-1].num_rows
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def top_k(vectors: DataFrame, queries: DataFrame | Column, k: int = 5, block: int = QUERY_BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query with all other ``vectors``: query_id, rank, vec_id, score.

    ``queries`` is a condition on the rows of ``vectors``: each of these is a query and is kept from itself alone; or it
    is a table of its own: then candidates of a query's id are left out. Components become floor(256 * x). Vectors and
    queries that are null or hold null or non-finite components take no part, nor do rows with a null id. Ties go to the
    smaller vec_id. Vectors of different lengths lack their last terms, which weigh nothing; an empty vector scores 0.
    Repeated rows count, and ask, as often as they occur. Fewer candidates than k: all of them. Empty tables give no
    rows. Other columns are ignored. Scores are exact below 2**63; what is beyond is taken modulo 2**64.

    Queries go out in blocks of ``block`` rows and of ``QUERY_BYTES`` at most, so what is broadcast is bounded however many there are.
    Each partition of candidates selects its k best per query; these are merged.
    """
    short_batches(vectors.sparkSession)
    shape = lambda df, *more: df.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding)).alias("v"), *more).filter("vec_id is not null and v is not null")
    if isinstance(queries, Column):
        base = written(shape(vectors, queries.alias("asks"), F.monotonically_increasing_id().alias("own")), "vectors")
        ask = base.filter("asks").select("vec_id", "v", "own")
    else:
        base = shape(vectors).withColumn("own", F.col("vec_id"))
        ask = shape(queries).withColumn("own", F.col("vec_id"))
    # rows of one id are spread by their number; each gets a number of its own in the order of ids
    ask = written(ask.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange("vec_id", "__n").sortWithinPartitions("vec_id", "__n").drop("__n").withColumn("query", F.monotonically_increasing_id()), "queries")
    out = None
    for lo, hi in _blocks(ask, block):
        some = written(_best(base.select("vec_id", "v", "own"), ask.filter((F.col("query") >= lo) & (F.col("query") < hi)).orderBy("query").toArrow(), k), "top")
        out = some if out is None else out.union(some)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(ask: DataFrame, block: int) -> list[tuple[int, int]]:
    """Bounds of numbers between which there are few enough queries: partitions together where they fit, else parts of one."""
    parts = ask.groupBy(F.shiftright("query", 33).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("terms")).orderBy("p").collect()  # a row per partition
    most = max(1, min(block, QUERY_BYTES // (8 * max([1, *(r["terms"] for r in parts)]))))
    out, held = [], 0
    for r in parts:
        first = r["p"] << 33
        if out and held + r["n"] <= most:
            out[-1] = (out[-1][0], first + r["n"])
            held += r["n"]
            continue
        out += [(first + lo, first + min(lo + most, r["n"])) for lo in range(0, r["n"], most)]
        held = (r["n"] - 1) % most + 1
    return out


def _best(base: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    numbers, ids, own = (asked.column(c).to_numpy() for c in ("query", "vec_id", "own"))
    lists = asked.column("v").combine_chunks()
    terms = int(np.diff(np.asarray(lists.offsets)).max(initial=0))
    shared = base.sparkSession.sparkContext.broadcast((numbers, ids, own, np.ascontiguousarray(_postings(lists, terms).T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, own, weights = shared.value
        # the best so far: scores and ids by query and place
        top_s, top_v = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64)
        have = np.zeros((len(ids), 0), bool)
        for t in _joined(batches, CANDIDATE_BLOCK):
            cand, v, rows = (t.column(c).combine_chunks() for c in range(3))
            cand, post, rows = cand.to_numpy(), _postings(v, weights.shape[1]), rows.to_numpy()
            new_s, new_v, new_h = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), bool)
            for q in range(0, len(ids), GROUP):
                scores = accumulate(weights[q : q + GROUP], post)
                row, at = select_top(scores, cand, k, own[q : q + GROUP, None] == rows[None, :])
                place = np.arange(len(row)) - np.searchsorted(row, row, "left")
                new_s[q + row, place], new_v[q + row, place], new_h[q + row, place] = scores[row, at], cand[at], True
            s, v, h = np.concatenate((top_s, new_s), 1), np.concatenate((top_v, new_v), 1), np.concatenate((have, new_h), 1)
            order = np.lexsort((v, -s, ~h), axis=1)[:, :k]
            top_s, top_v, have = (np.take_along_axis(x, order, 1) for x in (s, v, h))
        n = have.sum(axis=1) if have.size else np.zeros(len(ids), int)
        if n.sum():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, n)), pa.array(np.repeat(ids, n)), pa.array(top_v[have]), pa.array(top_s[have])], names=["query", "query_id", "vec_id", "score"])

    return base.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """The five nearest of each vector whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
