"""An approximate index of vectors: cells around centres, searched by the nearest few, with exact scores in them.

Equal vectors are one class, so copies cost no pairs, and dense regions get as many cells as they have rows. Neighbouring
cells form regions, and a class that asks goes once to each region that has one of its cells, so what is shuffled grows with
regions and not with cells. What a task holds is a piece of a region's classes and a piece of those that ask there, both of bounded rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.functions import urls
from weftline.operators.clustering import Vectors
from weftline.operators.similarity import chosen
from weftline.plans.tables import dropped, written

#: Classes of a cell on average, cells at most, rows of the sample that places a cell's centre (so their product bounds the sample), and rounds of it.
CELL_ROWS, MOST_CELLS, SAMPLE, ROUNDS = 512, 4096, 32, 8
#: Classes by which the number of probes is chosen, and the share of their nearest that these must reach.
TRIED, RECALL = 256, 0.93
#: Classes of a piece on average, at most and at least, and of those that ask, at most; those of one product; pieces that meet, for each core, before pieces grow to that.
FOUND, LEAST, ASKING, PRODUCT, MEETINGS = 49_152, 1024, 49_152, 2048, 4


def _near(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest centres of each row, nearest first, ties to the smaller number."""
    d = (centres * centres).sum(axis=1) / 2 - x @ centres.T
    some = np.argpartition(d, most - 1, axis=1)[:, :most] if most < len(centres) else np.tile(np.arange(len(centres)), (len(x), 1))
    some.sort(axis=1)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def centres(vectors: DataFrame, n: int, cells: int | None = None) -> np.ndarray:
    """Centres of cells by k-means over a sample (those of the smallest hashed ``cls``) of SAMPLE rows a cell. ``vectors``: n rows of cls and u."""
    k = max(1, min(n, cells or min(MOST_CELLS, -(-n // CELL_ROWS))))
    got = vectors.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE * k).select("u").toArrow().column("u").combine_chunks()  # SAMPLE * MOST_CELLS rows at most
    x = np.asarray(got.flatten()).reshape(len(got), -1)
    out = x[np.random.RandomState(1).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near = np.concatenate([_near(x[i : i + 8192], out, 1)[:, 0] for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        out = out.copy()
        out[near[order][first]] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return out


def celled(classes: DataFrame, middles: np.ndarray, probes: int) -> DataFrame:
    """``classes`` (cls, u) with ``cells``: those nearest to each, its own first."""
    shared = classes.sparkSession.sparkContext.broadcast(middles)
    most = min(probes, len(middles))

    def run(batches):
        for b in batches:
            near = _near(np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1), shared.value, most)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(near.ravel(), pa.int32()), most).cast(pa.list_(pa.int32()))], names=["cls", "u", "cells"])

    return classes.select("cls", "u").mapInArrow(run, "cls long, u array<double>, cells array<int>")


def probes_for(classes: DataFrame, middles: np.ndarray, most: int, recall: float = RECALL) -> int:
    """The fewest probes that reach a share ``recall`` of the ``most`` nearest classes, by TRIED classes (of the smallest hashed cls) against all of them.

    ``classes`` has cls and u. One pass finds the exact nearest of those tried, with their cells; where these stand among a class's nearest cells says what each number of probes finds.
    """
    tried = classes.orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(TRIED).select("cls", "u").toArrow()
    ids, x = tried.column("cls").to_numpy(), np.asarray(tried.column("u").combine_chunks().flatten()).reshape(tried.num_rows, -1)
    shared = classes.sparkSession.sparkContext.broadcast((ids, x, middles))

    def run(batches):
        ids, x, middles = shared.value
        for b in batches:
            own, y = b.column(0).to_numpy(), np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
            sims = x @ y.T
            sims[ids[:, None] == own[None, :]] = -9
            k = min(most, len(own))
            at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            cell = _near(y, middles, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), k)), pa.array(np.take_along_axis(sims, at, 1).ravel()), pa.array(cell[at.ravel()])], names=["q", "sim", "cell"])

    place = F.row_number().over(W.partitionBy("q").orderBy(F.col("sim").desc(), "cell"))
    best = classes.select("cls", "u").mapInArrow(run, "q long, sim double, cell long").filter("sim > -2").withColumn("place", place).filter(F.col("place") <= most).select("q", "cell").toArrow()  # TRIED * most rows
    rank = np.argsort(_near(x, middles, len(middles)), axis=1)[best.column("q").to_numpy(), best.column("cell").to_numpy()]
    reached = np.cumsum(np.bincount(rank, minlength=len(middles))) / max(1, len(rank))
    return int(np.searchsorted(reached, recall)) + 1 if len(rank) else 1


def regions(middles: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The region of each cell: cells with ``rows`` each, halved across their longest axis until a part has about ``most`` rows."""
    out, todo, n = np.zeros(len(rows), np.int32), [(np.arange(len(rows)), -(-int(rows.sum()) // most))], 0
    while todo:
        at, parts = todo.pop()
        if parts <= 1 or len(at) == 1:
            out[at], n = n, n + 1
            continue
        x = middles[at] - middles[at].mean(axis=0)
        order = at[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        upto = np.cumsum(rows[order])
        cut = min(max(int(np.searchsorted(upto, upto[-1] * (parts // 2) / parts)) + 1, 1), len(at) - 1)
        todo += [(order[cut:], parts - parts // 2), (order[:cut], parts // 2)]
    return out


def _best(x: np.ndarray, asked: np.ndarray, y: np.ndarray, ends: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Rows of x, rows of y and similarities: the ``most`` best of y for each of x, in the cells it asks. ``y`` is in order of cell, and cell c ends before ``ends[c]``."""
    least = np.full(len(x), -np.inf)  # what a row must reach, a rounding below the last of its best
    s, t, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    new: list[tuple[np.ndarray, ...]] = []

    def kept(parts):
        s, t, sims = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((first[t], -sims, s))
        s, t, sims = s[order], t[order], sims[order]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        last = place == most - 1
        least[s[last]] = sims[last] - 1e-6
        return s[place < most], t[place < most], sims[place < most]

    cells = [(c, lo, min(lo + PRODUCT, end)) for c, (start, end) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)) for lo in range(start, end, PRODUCT)]
    for c, lo, hi in cells:
        rows = np.flatnonzero(asked[:, c])
        if not len(rows):
            continue
        found = x[rows] @ y[lo:hi].T
        if hi - lo > most and (none := np.isinf(least[rows])).any():
            least[rows[none]] = np.partition(found[none], hi - lo - most, axis=1)[:, hi - lo - most] - 1e-6
        r, at = np.nonzero(found >= least[rows][:, None])
        new.append((rows[r], lo + at, np.round(found[r, at], 6)))
        if sum(len(p[0]) for p in new) > 2 * most * len(x):
            (s, t, sims), new = kept([(s, t, sims), *new]), []
    return kept([(s, t, sims), *new])


def nearest_classes(found: DataFrame, asking: DataFrame, most: int, middles: np.ndarray) -> DataFrame:
    """source, target and similarity (6 decimals): for each class that asks (cls, u, cells) the ``most`` best of those in its cells (cls, u, cells, first), ties to the smaller ``first``.

    Cells, whose centres are ``middles``, form regions, and these are split into pieces by their counts; every piece of askers meets every piece of their region once.
    """
    spark = found.sparkSession
    rows = np.zeros(len(middles), np.int64)
    for r in found.groupBy(F.col("cells")[0].alias("cell")).count().collect():  # a row a cell, MOST_CELLS at most
        rows[r["cell"]] = r["count"]
    side = int(np.ceil(np.sqrt(MEETINGS * spark.sparkContext.defaultParallelism)))
    sized = lambda n, bound: min(bound, max(LEAST, -(-n // side)))
    most_found, most_asking = sized(int(rows.sum()), FOUND), sized(asking.count(), ASKING)
    region = regions(middles, rows, most_found)
    members = [np.flatnonzero(region == g) for g in range(region.max() + 1)]
    slot = np.zeros(len(region), np.int32)
    for m in members:
        slot[m] = np.arange(len(m))
    shared = spark.sparkContext.broadcast((len(region), members))

    def asked(cells: pa.Array):
        n, members = shared.value
        on = np.zeros((len(cells), n), bool)
        np.put_along_axis(on, np.asarray(cells.flatten()).reshape(len(cells), -1), True, axis=1)
        for g, m in enumerate(members):
            at = np.flatnonzero(on[:, m].any(axis=1))
            if len(at):
                yield g, at, on[np.ix_(at, m)]

    def count(batches):
        for b in batches:
            got = [(g, len(at)) for g, at, _ in asked(b.column(0))] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int32()), pa.array([n for _, n in got], pa.int64())], names=["region", "n"])

    def spread(batches):
        for b in batches:
            for g, at, on in asked(b.column(2)) if b.num_rows else ():
                bits = [x.tobytes() for x in np.packbits(on, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(bits, pa.binary())], names=["region", "s", "su", "asked"])

    asks = {r["region"]: r["n"] for r in asking.select("cells").mapInArrow(count, "region int, n long").groupBy("region").agg(F.sum("n").alias("n")).collect()}
    pieces = lambda n, bound: max(1, round(n / bound))
    split = [(g, pieces(int(rows[m].sum()), most_found), pieces(asks[g], most_asking)) for g, m in enumerate(members) if g in asks and rows[m].sum()]
    meetings = sum(tp * sp for _, tp, sp in split)
    sizes = F.broadcast(spark.createDataFrame(split, "region int, tp int, sp int"))
    placed = F.broadcast(spark.createDataFrame([(c, int(region[c]), int(slot[c])) for c in range(len(region))], "cell int, region int, slot int"))
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = found.select(F.col("cells")[0].alias("cell"), F.col("cls").alias("t"), F.col("u").alias("tu"), "first").join(placed, "cell").join(sizes, "region")
    own = own.select("region", pick("t", "tp").alias("a"), every("sp").alias("b"), "slot", "t", "tu", "first")
    ask = asking.select("cls", "u", "cells").mapInArrow(spread, "region int, s long, su array<double>, asked binary").join(sizes, "region")
    ask = ask.select("region", every("tp").alias("a"), pick("s", "sp").alias("b"), "s", "su", "asked")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            matrix = lambda c: np.asarray(c.combine_chunks().flatten()).reshape(len(c), -1)
            slot = right.column("slot").to_numpy()
            order = np.argsort(slot, kind="stable")
            y, t, first = matrix(right.column("tu"))[order], right.column("t").to_numpy()[order], right.column("first").to_numpy()[order]
            parts = []
            for lo in range(0, left.num_rows, PRODUCT):
                some = left.slice(lo, PRODUCT)
                on = np.unpackbits(np.frombuffer(b"".join(some.column("asked").to_pylist()), np.uint8).reshape(some.num_rows, -1), axis=1).astype(bool)
                ends = np.searchsorted(slot[order], np.arange(on.shape[1]), side="right")
                i, at, sims = _best(matrix(some.column("su")), on, y, ends, first, most)
                parts.append((some.column("s").to_numpy()[i], t[at], sims, first[at]))
            out = [np.concatenate(p) for p in zip(*parts, strict=True)]
        return pa.table(dict(zip(("source", "target", "similarity", "first"), map(pa.array, out), strict=True)))

    keys = ["region", "a", "b"]
    apart = lambda df: df.repartition(max(1, min(2 * meetings, 4096)), *keys).groupBy(*keys)
    pairs = apart(ask).cogroup(apart(own)).applyInArrow(meet, "source long, target long, similarity double, first long")
    place = F.row_number().over(W.partitionBy("source").orderBy(F.col("similarity").desc(), "first"))
    return pairs.withColumn("place", place).filter(F.col("place") <= most).select("source", "target", "similarity")


def link_suggestions_indexed(items: DataFrame, per_item: int = 5, min_sim: float = 0.45, exclude: str | None = None, fallback: bool = False, probes: int | None = None, cells: int | None = None) -> DataFrame:
    """As ``similarity.link_suggestions``, from the ``probes`` cells nearest to each item instead of all items.

    Without ``probes``, as few as find ``RECALL`` of what a sample of items has nearest (``probes_for``). A pair is missed only
    if its target's cell is not among them, or if more than 2 * per_item classes of one path are nearer. Work grows with
    items * probes * CELL_ROWS up to MOST_CELLS cells, and with cells that grow in size beyond.
    """
    t = Vectors(items, keep=("url",))
    on = t.df.withColumn("at", F.coalesce("url", F.lit(""))).withColumns({"path": urls.path(F.col("at")), "home": urls.is_homepage(F.col("at"))}).drop("at")
    on = on.filter(~urls.matches(F.col("path"), exclude))
    classes = written(on.groupBy("u").agg(F.min("row").alias("cls"), F.min(F.when(~F.col("home"), F.col("row"))).alias("first")), "classes")
    n = classes.count()
    if not n:
        return items.sparkSession.createDataFrame([], "source_id long, target_id long, source_url string, target_url string, similarity double")
    middles = centres(classes, n, cells)
    placed = written(celled(classes, middles, probes or probes_for(classes, middles, per_item)).join(classes.select("cls", "first"), "cls"), "placed")
    near = written(nearest_classes(placed.filter("first is not null"), placed, 2 * per_item, middles), "near")
    rows = written(on.join(classes.select("u", "cls"), "u").select("row", "id", "url", "path", "home", "cls"), "rows")
    # of a class, what any source can need: of each path as many rows as are asked for, and twice as many of all
    of_path = F.row_number().over(W.partitionBy("cls", "path").orderBy("row"))
    of_class = F.row_number().over(W.partitionBy("cls").orderBy("row"))
    kept = rows.filter(~F.col("home")).withColumn("p", of_path).filter(F.col("p") <= per_item).withColumn("p", of_class).filter(F.col("p") <= 2 * per_item)
    to = kept.select(F.col("cls").alias("target"), F.col("row").alias("t"), F.col("path").alias("tp"))
    pairs = rows.select(F.col("cls").alias("source"), F.col("row").alias("s"), F.col("path").alias("sp")).join(near, "source").join(to, "target").filter("sp <> tp")
    pairs = pairs.select(F.col("s").alias("source"), F.col("t").alias("target"), "similarity")
    out = written(chosen(pairs, rows.select("row", "id", "url"), per_item, min_sim, fallback), "links")
    dropped(classes, placed, near, rows)
    return out
