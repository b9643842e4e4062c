"""Clusters of items: k-means, centroids, previews, topic labels."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.functions import text, vectors
from weftline.plans.tables import dropped, numbered, written


def status(items: DataFrame) -> DataFrame:
    """Per domain: items, those with an embedding, with a cluster, distinct clusters, longest embedding. One pass."""
    has = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return items.groupBy("domain").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(has).alias("embedded"), F.count("cluster_id").alias("clustered"),
        F.countDistinct("cluster_id").alias("clusters"), F.max(F.when(has, F.size("embedding"))).alias("dim"),
    )


def dimensions(items: DataFrame) -> int:
    """The length of the longest embedding; 0 without any."""
    return items.agg(F.max(F.size("embedding"))).first()[0] or 0


def sizes(items: DataFrame, k: int | None = None) -> DataFrame:
    """cluster_id and size of the clusters 0 to k - 1, empty ones too, largest first. Without k: up to the highest that has members."""
    own = items.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    k = k if k is not None else effective(own)
    ids = items.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return ids.join(own, "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0)).alias("size")).orderBy(F.col("size").desc(), "cluster_id")


def effective(items: DataFrame) -> int:
    """One more than the highest cluster that has members; gaps count."""
    most = items.agg(F.max("cluster_id")).first()[0]
    return 0 if most is None else most + 1


def centroids(items: DataFrame, cluster: str = "cluster_id", dim: int | None = None) -> DataFrame:
    """cluster, size and centroid: the mean of the members' unit vectors, at length one. Shorter vectors lack their last components, which count as 0.

    There are ``dim`` partial sums a cluster (None: as many as the longest embedding has components), no exploded rows.
    """
    dim = dim or dimensions(items)
    u = items.filter(F.col("embedding").isNotNull() & F.col(cluster).isNotNull()).select(cluster, vectors.unit(F.col("embedding")).alias("u"))
    mean = u.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.array(*[F.avg(F.coalesce(F.get("u", F.lit(i)), F.lit(0.0))) for i in range(dim)]).alias("mean"))
    return mean.select(cluster, "size", vectors.unit(F.col("mean")).alias("centroid"))


def nearest(items: DataFrame, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """Items with ``near``, the centre of least squared distance to their unit vector; ties to the smallest number. A few centres are literals of the plan."""
    d = lambda c: F.aggregate(F.zip_with("u", F.lit(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    best = F.least(*[F.struct(d(c).alias("d"), F.lit(i).alias("c")) for i, c in centres]) if len(centres) > 1 else F.struct(F.lit(0.0).alias("d"), F.lit(centres[0][0]).alias("c"))
    return items.withColumn("u", vectors.unit(F.col("embedding"))).withColumn("near", best["c"]).drop("u")


class Vectors:
    """A table of unit vectors: row (a number of its own, in the order of id), id, the columns kept, and ``u``.

    Every operator on vectors takes its items through it. Embeddings may be arrays, structs with ``data`` or JSON text;
    entries that are no finite numbers are dropped, and items without any entry are left out. Shorter vectors have zeros
    at their end, up to ``dim`` components (None: as many as the longest has); longer ones are cut. Ids may repeat or be null.
    """

    def __init__(self, items: DataFrame, dim: int | None = None, keep: tuple[str, ...] = ()) -> None:
        v = vectors.coerced(items)
        some = items.select(F.col("id").cast("long").alias("id"), *keep, vectors.unit(F.slice(v, 1, dim) if dim else v).alias("u")).filter("u is not null")
        order = [F.col("id").asc_nulls_last(), *keep, F.xxhash64("u")]
        table, self.n, found = numbered(some, order, "vectors", dim=F.size("u"))
        self.dim = dim or found["dim"] or 0
        self.df = table.withColumn("u", vectors.padded(F.col("u"), F.lit(self.dim)))

    def at(self, rows: list[int]):
        """The vectors of a few rows, as a matrix in their order."""
        import numpy as np

        got = {r["row"]: r["u"] for r in self.df.filter(F.col("row").isin(sorted(set(rows)))).select("row", "u").collect()}
        return np.array([got[r] for r in rows]).reshape(len(rows), self.dim)


def _matrix(column):
    import numpy as np

    return np.asarray(column.flatten()).reshape(len(column), -1)


def _nearest(x, centres):
    """Squared distances to each centre. A centre at a time, so that equal distances are equal numbers."""
    import numpy as np

    far = np.empty((len(x), len(centres)))
    for i, c in enumerate(centres):
        far[:, i] = ((x - c) ** 2).sum(axis=1)
    return far


def _assigned(t: Vectors, centres) -> DataFrame:
    """id and cluster of vectors by the centre of least squared distance, ties to the smallest number, by whole matrices of Arrow batches."""
    import pyarrow as pa

    shared = t.df.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_nearest(_matrix(batch.column(1)), shared.value).argmin(axis=1), pa.int32())], names=["id", "cluster"])

    return t.df.select("id", "u").mapInArrow(run, "id long, cluster int")


#: Bytes of partial sums that come to the driver as they are; more are added up by tasks first.
SUMS_BYTES = 1 << 26


def _sums(held: DataFrame, centres):
    """For sets of centres (sets, k, dim): n, mark, far and sum of the members of each centre, in one pass for all sets.

    ``mark`` is a 64-bit sum that tells assignments apart, ``far`` that of squared distances. A task sends one row.
    """
    import numpy as np
    import pyarrow as pa

    sets, k, dim = centres.shape
    context = held.sparkSession.sparkContext
    shared, tasks = context.broadcast(centres), 2 * context.defaultParallelism

    def run(batches):
        n, mark, far, total = np.zeros((sets, k), np.int64), np.zeros((sets, k), np.uint64), np.zeros((sets, k)), np.zeros((sets, k, dim))
        for batch in batches:
            x = _matrix(batch.column(1))
            h = (batch.column(0).to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            for s, c in enumerate(shared.value):
                d = _nearest(x, c)
                near = d.argmin(axis=1)
                for i in np.unique(near):
                    own = near == i
                    n[s, i] += own.sum()
                    mark[s, i] += (h[own] * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
                    far[s, i] += d[own, i].sum()
                    total[s, i] += x[own].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (n, mark, far, total)], names=["n", "mark", "far", "sum"])

    def add(batches):
        found = None
        for batch in batches:
            for r in batch.to_pylist():
                one = _arrays(r, sets, k, dim)
                found = one if found is None else tuple(a + b for a, b in zip(found, one, strict=True))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in found], names=["n", "mark", "far", "sum"])

    kinds = "n binary, mark binary, far binary, sum binary"
    parts = held.coalesce(tasks).mapInArrow(run, kinds)
    while tasks * 8 * sets * k * (dim + 3) > SUMS_BYTES and tasks > 8:
        tasks = -(-tasks // 8)
        parts = parts.repartition(tasks).mapInArrow(add, kinds)
    return tuple(sum(x) for x in zip(*(_arrays(r, sets, k, dim) for r in parts.collect()), strict=True))


def _arrays(r, sets: int, k: int, dim: int):
    import numpy as np

    return tuple(np.frombuffer(r[c], kind).reshape(shape) for c, kind, shape in (("n", np.int64, (sets, k)), ("mark", np.uint64, (sets, k)), ("far", np.float64, (sets, k)), ("sum", np.float64, (sets, k, dim))))


def _lloyd(held: DataFrame, centres, rounds: int):
    """The last centres of each set and the sums of squared distances to those before them. A set ends when a round moves no row; sets share their passes."""
    import numpy as np

    centres, cost, last = centres.copy(), np.zeros(len(centres)), {}
    on = list(range(len(centres)))
    for _ in range(rounds):
        n, mark, far, total = _sums(held, centres[on])
        going = []
        for at, s in enumerate(on):
            cost[s] = far[at].sum()
            now = (n[at].tobytes(), mark[at].tobytes())
            if last.get(s) != now:
                last[s] = now
                some = n[at] > 0
                centres[s][some] = total[at][some] / n[at][some, None]
                going.append(s)
        on = going
        if not on:
            break
    return centres, cost


def kmeans(items: DataFrame, k: int = 8, seed: int = 42, rounds: int = 50, dim: int | None = None, start: list[int] | None = None) -> DataFrame:
    """Lloyd's k-means of id and embedding: id, cluster, a row for each item that has a vector (``Vectors``). Deterministic for a seed.

    The first centres are the unit vectors of k rows drawn by number in the order of id, or of the numbers ``start``. A cluster that becomes empty keeps its
    centre. It ends when nothing changes, or after ``rounds``. Each round is one pass over vectors that are held in memory; a task sends k sums.
    """
    t = Vectors(items, dim)
    if not t.n:
        return items.sparkSession.createDataFrame([], "id long, cluster int")
    drawn = [r for r in start if r < t.n] if start else random.Random(seed).sample(range(t.n), max(1, min(k, t.n)))
    held = t.df.select("row", "u").persist()
    centres, _ = _lloyd(held, t.at(drawn)[None], rounds)
    held.unpersist()
    return _assigned(t, centres[0])


def kmeans_restarts(items: DataFrame, k: int = 8, seeds: tuple[int, ...] = tuple(range(42, 52)), rounds: int = 50, dim: int | None = None, passes: int = 4) -> DataFrame:
    """The k-means of those seeds whose members are nearest to their centres, by the sum of squared distances; ties to the first.

    The first centres are drawn by k-means||: in each of ``passes`` rounds 2k rows, the likelier the farther they are from
    those drawn so far; then k of these, weighted by the rows nearest to them. All seeds go through the same passes.
    """
    t = Vectors(items, dim)
    if not t.n:
        return items.sparkSession.createDataFrame([], "id long, cluster int")
    held = t.df.select("row", "u").persist()
    centres, cost = _lloyd(held, _spread(t, held, max(1, min(k, t.n)), seeds, passes), rounds)
    held.unpersist()
    return _assigned(t, centres[int(cost.round(9).argmin())])


def _spread(t: Vectors, held: DataFrame, k: int, seeds: tuple[int, ...], passes: int):
    """First centres (seeds, k, dim) by k-means||."""
    import numpy as np
    import pyarrow as pa

    some = [t.at([random.Random(seed).randrange(t.n)]) for seed in seeds]
    kinds = "set int, key double, u array<double>"

    def best(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["set", "key", "u"])

    for step in range(passes):
        shared = held.sparkSession.sparkContext.broadcast(some)

        def draw(batches, shared=shared, step=step):
            found = [[] for _ in seeds]
            for batch in batches:
                rows, x = batch.column(0).to_numpy().astype(np.uint64), _matrix(batch.column(1))
                for s, c in enumerate(shared.value):
                    d = np.maximum((x * x).sum(axis=1) - (2 * x @ c.T - (c * c).sum(axis=1)).max(axis=1), 0)
                    h = (rows * np.uint64(len(seeds) * passes) + np.uint64(s * passes + step + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                    key = -np.log(((h ^ h >> np.uint64(32)) >> np.uint64(11)).astype(float) / 2**53 + 2**-54) / np.maximum(d, 1e-300)
                    for i in np.argsort(key)[: 2 * k]:
                        if d[i] > 1e-12:
                            found[s].append((s, float(key[i]), x[i].tolist()))
                    found[s] = sorted(found[s])[: 2 * k]
            yield best([r for own in found for r in own])

        def least(batches):
            found = {}
            for batch in batches:
                for r in batch.to_pylist():
                    found.setdefault(r["set"], []).append((r["set"], r["key"], r["u"]))
                found = {s: sorted(own)[: 2 * k] for s, own in found.items()}
            yield best([r for own in found.values() for r in own])

        drawn = held.mapInArrow(draw, kinds).repartition("set").mapInArrow(least, kinds).orderBy("set", "key").collect()  # 2k rows a seed
        some = [np.concatenate([c, *(np.array([r["u"]]) for r in drawn if r["set"] == s)]) for s, c in enumerate(some)]
    most = max(map(len, some))
    weight, *_ = _sums(held, np.stack([np.concatenate([c, np.repeat(c[:1], most - len(c), axis=0)]) for c in some]))
    return np.stack([_seeded(c, w[: len(c)], k, seed) for c, w, seed in zip(some, weight, seeds, strict=True)])


def _seeded(points, weight, k: int, seed: int):
    """k of a few weighted points by k-means++, moved to the means of the points nearest to them a few times."""
    import numpy as np

    rnd = np.random.RandomState(seed)
    chosen = [points[rnd.choice(len(points), p=weight / weight.sum())]]
    while len(chosen) < k:
        far = _nearest(points, chosen).min(axis=1) * weight
        chosen.append(points[rnd.choice(len(points), p=far / far.sum()) if far.sum() > 0 else rnd.randint(len(points))])
    centres = np.array(chosen)
    for _ in range(10):
        near = _nearest(points, centres).argmin(axis=1)
        for i in range(k):
            own = (near == i) & (weight > 0)
            if own.any():
                centres[i] = np.average(points[own], axis=0, weights=weight[own])
    return centres


def members(items: DataFrame, dim: int | None = None) -> DataFrame:
    """Items with similarity to their cluster's centroid (6 decimals) and place by it; ties by id."""
    on = items.filter(F.col("embedding").isNotNull() & F.col("cluster_id").isNotNull())
    c = centroids(on, dim=dim)
    sim = F.round(vectors.dot(vectors.unit(F.col("embedding")), F.col("centroid")), 6)
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.col("similarity").desc(), "id"))
    return on.join(c, "cluster_id").withColumn("similarity", sim).drop("centroid").withColumn("place", place)


def preview(items: DataFrame, per_cluster: int = 5) -> DataFrame:
    """The items nearest to each centroid, with the cluster's size."""
    return members(items).filter(F.col("place") <= per_cluster).select("cluster_id", "size", "place", "id", "similarity")


def samples(items: DataFrame, per_cluster: int = 5) -> DataFrame:
    """Per cluster the titles nearest the centroid, in order; a url where the title is empty."""
    top = members(items).filter(F.col("place") <= per_cluster)
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("url"))
    return top.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", title.alias("t")))), lambda x: x["t"]), " | ").alias("titles"))


def label_text(title: Column, meta: Column, url: Column) -> Column:
    t = F.trim(F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(meta, F.lit(""))))
    return F.coalesce(F.nullif(t, F.lit("")), url)


def tfidf(docs: DataFrame, min_df: int = 2, max_ratio: float = 0.8, most: int = 2, stops: list[str] | None = None) -> DataFrame:
    """TF-IDF of the terms of each cluster, from (cluster_id, id, text): cluster_id, term, tf, df, docs, score, first.

    score = tf / N * (ln((N + 1) / (df + 1)) + 1), for min_df <= df <= max_ratio * N. ``first`` (id, place) orders ties.
    Counts are made per document before they are shuffled.
    """
    d = docs.filter(F.col("cluster_id").isNotNull())
    n = d.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("docs"))
    terms = d.select("cluster_id", "id", F.posexplode(text.ngrams(text.tokens(F.col("text"), stops), most)).alias("pos", "term"))
    per = terms.groupBy("cluster_id", "id", "term").agg(F.count(F.lit(1)).alias("c"), F.min("pos").alias("pos"))
    agg = per.groupBy("cluster_id", "term").agg(F.sum("c").alias("tf"), F.count(F.lit(1)).alias("df"), F.min(F.struct("id", "pos")).alias("first"))
    s = agg.join(n, "cluster_id").filter((F.col("df") >= min_df) & (F.col("df") <= max_ratio * F.col("docs")))
    return s.withColumn("score", F.round(F.col("tf") / F.col("docs") * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1), 9))


def top_terms(scored: DataFrame, top: int = 10) -> DataFrame:
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.col("score").desc(), "first"))
    return scored.withColumn("place", place).filter(F.col("place") <= top).select("cluster_id", "place", "term", "tf", "df", "score")


def labels(scored: DataFrame, top: int = 6, step: int = 256) -> DataFrame:
    """Each cluster's labels: terms by score, skipping one that holds or is held by a term already chosen.

    The best ``step`` terms of a cluster are found by partial limits, each task sending no more than that; only a cluster
    that has not enough labels by then goes on with those behind. So no term is cut off, and no task ranks a cluster's vocabulary.
    """
    spark = scored.sparkSession
    terms = written(scored.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("score").cast("double").alias("score"), "first", "term"), "terms")
    kind = terms.schema["first"].dataType.simpleString()
    done, open_ = [], terms.select("cluster_id").distinct().select("cluster_id", F.array().cast("array<string>").alias("labels"), F.lit(None).cast("double").alias("s"), F.lit(None).cast(kind).alias("f")).collect()  # a row per cluster
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.col("score").desc(), "first"))
    take = lambda acc, x: F.when((F.size(acc) < top) & ~F.exists(acc, lambda y: y.contains(x["term"]) | x["term"].contains(y)), F.array_append(acc, x["term"])).otherwise(acc)
    while open_:
        state = F.broadcast(spark.createDataFrame(open_, f"cluster_id int, labels array<string>, s double, f {kind}"))
        behind = terms.join(state.select("cluster_id", "s", "f"), "cluster_id").filter(F.col("s").isNull() | (F.col("score") < F.col("s")) | (F.col("score") == F.col("s")) & (F.col("first") > F.col("f")))
        some = behind.select("cluster_id", "score", "first", "term").withColumn("place", place).filter(F.col("place") <= step)
        some = some.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("place", "term", "score", "first"))).alias("t"))
        rows = state.join(some, "cluster_id").select("cluster_id", F.aggregate("t", F.col("labels"), take).alias("labels"), F.element_at("t", -1)["score"].alias("s"), F.element_at("t", -1)["first"].alias("f"), F.size("t").alias("n")).collect()
        more = [r for r in rows if len(r["labels"]) < top and r["n"] == step]
        going = {r["cluster_id"] for r in more}
        found = {r["cluster_id"]: r["labels"] for r in rows}
        done += [(r["cluster_id"], found.get(r["cluster_id"], r["labels"])) for r in open_ if r["cluster_id"] not in going]
        open_ = [Row(**{c: r[c] for c in ("cluster_id", "labels", "s", "f")}) for r in more]
    dropped(terms)
    return spark.createDataFrame(done, "cluster_id int, labels array<string>")


def corpus_terms(docs: DataFrame, top: int = 5, features: int = 5000, stops: list[str] | None = None) -> DataFrame:
    """The terms of the highest mean TF-IDF of each cluster, from (cluster_id, id, text): cluster_id, place, term, score (6 decimals).

    The ``features`` most frequent terms of the corpus count, ties to the first by name. A document's weights tf * (ln((1 +
    N) / (1 + df)) + 1) are at length one, and a cluster's score is their mean over its documents. Ties go by term.
    """
    d = docs.filter(F.col("cluster_id").isNotNull())
    n = d.count()
    per = written(d.select("cluster_id", "id", F.explode(text.terms(F.col("text"), stops)).alias("term")).groupBy("cluster_id", "id", "term").agg(F.count(F.lit(1)).alias("tf")), "terms")  # texts are read once
    known = per.groupBy("term").agg(F.sum("tf").alias("all"), F.count(F.lit(1)).alias("df")).orderBy(F.col("all").desc(), "term").limit(features)
    idf = F.log((F.lit(1.0) + n) / (F.col("df") + 1)) + 1
    w = per.join(known, "term").select("cluster_id", "id", "term", (F.col("tf") * idf).alias("w"))
    size = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    of = d.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("docs"))
    mean = w.join(size, "id").groupBy("cluster_id", "term").agg(F.sum(F.col("w") / F.col("size")).alias("sum")).join(of, "cluster_id")
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.col("score").desc(), "term"))
    return mean.withColumn("score", F.round(F.col("sum") / F.col("docs"), 6)).withColumn("place", place).filter(F.col("place") <= top).select("cluster_id", "place", "term", "score")
