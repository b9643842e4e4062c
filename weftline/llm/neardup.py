"""Near-duplicate groups by SetSketch registers, banded, estimated jointly by likelihood, and verified on full sets.

Texts with the same set of shingles are one node, so large groups of exact copies cost one row each from then on. Within
a band's bucket, members first meet a few pivots drawn by hash, never all others. One likely pair of each node is checked
on full sets first, then the other pairs between components that are left. What is still in different components then
meets within the bucket under a bound from bitmaps, which lets through pairs that can be links and little else. So every
candidate pair of a bucket is either decided exactly or already connected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.tables import dropped, written

from .shared import M64, NOT_SPACE, mix, null_safe_text, release, short_batches, slices, text_buffers, word_hashes

#: Longs of a bitmap; pivots of a bucket.
LONGS, PIVOTS = 16, 3
BITS = [f"b{i}" for i in range(LONGS)]
#: Registers of a sketch; base and rate of SetSketch: 1.001 and 20 fit sets up to 10**9 in 16 bits.
REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, (1 << 16) - 1
_K = [np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xA5A3564E27F8862F, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_G = 0x9E3779B97F4A7C15


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words; of fewer words, of the whole sequence."""
    n = len(words) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        h += (words[k : k + len(h)] ^ _K[k % 8]) * np.uint64(int(_K[(k + 3) % 8]) + 2 * (k // 8) & M64)
        h = mix(h)
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(h[lo : hi - size + 1]))
        elif hi > lo:
            short = np.uint64([hi - lo])
            for k in range(lo, hi):
                short = mix(short + (words[k : k + 1] ^ _K[(k - lo) % 8]) * _K[(k - lo + 5) % 8])
            out.append(short)
        else:
            out.append(h[:0])
    return out


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers, one row a set; of empty sets, zeros.

    Each element is the seed of a Poisson process of rate m * RATE whose points fall on registers evenly, so a register's
    first point of an element is exponential with RATE, independently of the others. A register keeps the smallest point
    over all elements, on an exponential scale, truncated to 16 bits. An element's points are drawn only while they can
    still be below the largest minimum of its set.
    """
    d = len(sets)
    low = np.full((d, m), np.inf)
    own = np.repeat(np.arange(d), [len(s) for s in sets])
    seed = np.concatenate(sets) if d else np.zeros(0, np.uint64)
    x = np.zeros(len(seed))
    t, step = 1, 1
    flat = low.reshape(-1)
    while len(seed):
        for _ in range(step):
            u = mix(seed + np.uint64(_G * t & M64))
            x = x - np.log(((u >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / (m * RATE)
            reg = ((u & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)
            np.minimum.at(flat, own * m + reg.astype(np.int64), x)
            t += 1
        rows, back = np.unique(own, return_inverse=True)
        on = x < low[rows].max(axis=1)[back]
        own, seed, x = own[on], seed[on], x[on]
        step = 1 if t < 6 else min(64, t // 3)
    k = np.zeros((d, m), np.uint16)
    full = np.isfinite(low[:, 0]) if d else np.zeros(0, bool)
    k[full] = np.clip(np.floor(1 - np.log(low[full]) / math.log(BASE)) + 20_000, 0, TOP).astype(np.uint16)
    return k


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity most likely for register rows a and b, given the sets' sizes (Ertl's joint estimator).

    The counts of registers that are larger, smaller and equal are trinomial with p(u - v J), p(v - u J) and the rest,
    where p(x) = -log_base(1 - x (base - 1) / base). The likelihood's one maximum is found by ternary search.
    """
    u, v = na / (na + nb), nb / (na + nb)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    p = lambda x: np.clip(-np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE), 1e-12, 1 - 1e-12)

    def likelihood(j: np.ndarray) -> np.ndarray:
        g, s = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        return more * np.log(g) + less * np.log(s) + same * np.log(np.clip(1 - g - s, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(x) < likelihood(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


def bands_for(threshold: float, m: int = REGISTERS, miss: float = 1e-5) -> tuple[int, int]:
    """The longest bands, and their number, by which a pair at the threshold is missed with a probability of ``miss`` at most."""
    r = max((r for r in range(1, m + 1) if (1 - threshold**r) ** (m // r) <= miss), default=1)
    return r, m // r


def bitmaps(sets: list[np.ndarray], longs: int = LONGS) -> np.ndarray:
    """One row of ``longs`` 64-bit integers a set; an element sets the bit that its lowest bits number."""
    on = np.zeros((len(sets), 64 * longs), bool)
    for row, s in zip(on, sets, strict=True):
        row[(s % np.uint64(64 * longs)).astype(np.int64)] = True
    return np.packbits(on, axis=1, bitorder="little").view("<i8")


def can_link(percent: int) -> F.Column:
    """Whether sets a and b can be similar enough, by their sizes na, nb and bitmaps a0.., b0..: never false for a link.

    Each bit that only one of them has is an element that the other lacks.
    """
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{i}")))) for i in range(1, LONGS)), F.bit_count(F.col(f"{x}0").bitwiseAND(F.bitwise_not(F.col(f"{y}0")))))
    both = F.least(F.col("na") - lacks("a", "b"), F.col("nb") - lacks("b", "a"))
    return (100 + percent) * both >= percent * (F.col("na") + F.col("nb"))


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two longs that stand for each set; nulls for an empty one."""
    both = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
    none = np.array([not len(s) for s in sets], bool)
    return [pa.array(np.ascontiguousarray(both[:, i]), mask=none) for i in range(2)]


def _sketched(docs: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """row, doc_id, n, the set's digest s0 and s1, regs, bitmap b0.., and the string columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            data, off = text_buffers(part.column(2))
            sets = shingle_sets(*word_hashes(data, off, NOT_SPACE), size)
            regs, bits = sketches(sets), bitmaps(sets)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), *_digests(sets),
                pa.array([r.astype(">u2").tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary()),
                *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(LONGS)), *(part.column(3 + i) for i in range(len(keep))),
            ], names=["row", "doc_id", "n", "s0", "s1", "regs", *BITS, *keep])

    kinds = "row long, doc_id long, n long, s0 long, s1 long, regs binary" + "".join(f", {b} long" for b in BITS) + "".join(f", {c} string" for c in keep)
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *keep).mapInArrow(run, kinds)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """The digest and the full set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            data, off = text_buffers(part.column(0))
            sets = shingle_sets(*word_hashes(data, off, NOT_SPACE), size)
            own = pa.ListArray.from_arrays(np.cumsum([0, *(len(s) for s in sets)], dtype=np.int32), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*_digests(sets), own], names=["s0", "s1", "shingles"])

    return docs.mapInArrow(run, "s0 long, s1 long, shingles array<bigint>")


def _side(rows: DataFrame, c: str, *more: str) -> DataFrame:
    """node, n and bitmap as those of side ``c`` of a pair, and the columns ``more`` as they are."""
    return rows.select(*more, F.col("node").alias(c), F.col("n").alias(f"n{c}"), *[F.col(b).alias(f"{c}{b[1:]}") for b in BITS])


def _ordered(pairs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), the smaller node first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int, margin: float) -> DataFrame:
    """Pairs (a, b) whose likelihood estimate is within ``margin`` of the threshold, with the estimate as j."""
    least = percent / 100 - margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                ra, rb = (np.frombuffer(b"".join(t.column(c).to_pylist()), ">u2").reshape(t.num_rows, -1) for c in (2, 3))
                na, nb = (t.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in (4, 5))
                j = joint_estimate(ra, rb, na, nb)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(j)], names=["a", "b", "j"]).filter(pa.array(j >= least))
        release()

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("regs").alias(f"reg{c}"), F.col("n").alias(f"n{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "rega", "regb", "na", "nb").mapInArrow(run, "a long, b long, j double")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union on their full sets, from the text of one document of each node."""
    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reps, "node"), "needed")
    ids = needed.select(F.col("least").alias("wanted")).distinct()
    own = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    sets = written(_sets(own, words).join(needed.select("s0", "s1", "node"), ["s0", "s1"]).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    edges = written(pairs.join(side("b"), "b").join(side("a"), "a").filter((100 + percent) * both >= percent * (F.size("sa") + F.size("sb"))).select("a", "b"), "edges")
    dropped(needed, sets)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the smallest node that edges (a, b) reach, for each end of an edge.

    Rounds of smallest label over the neighbours, then of the label's own label, until nothing changes; each round is a
    table in the shared folder. Minima are partial before a shuffle, so a node with many edges is no hot task.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.join(label.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("up"))
        upper = label.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        new = written(step.join(upper, "up").select("node", F.least("up", "top").alias("comp"), (F.least("up", "top") < F.col("was")).alias("moved")), "labels")
        dropped(label)
        label = new.select("node", "comp")
        if new.filter("moved").isEmpty():
            dropped(both)
            return label


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components, with these as ca and cb; a node without a label is one by itself."""
    for c in ("a", "b"):
        own = label.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
        pairs = pairs.join(own, c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    return pairs.filter("ca <> cb")


def _joined(label: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of ``label`` with ``edges`` on top; both go."""
    top = components(_across(edges, label).select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    known = label.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    new = top.join(label.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("comp"))
    out = written(known.union(new), "components")
    dropped(top, label, edges)
    return out


def _members(nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The buckets of two nodes and more: key, node, size of the bucket, whether the node is one of its pivots, and whether the first.

    Buckets are counted first, and only the members of those that are left meet their pivots. Pivots are drawn by hash in
    each bucket, so a node meets as many others as it has buckets, several times over.
    """
    r, count = bands_for(percent / 100, REGISTERS, miss)
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + 2 * r * i, 2 * r)) for i in range(count)])
    bands = nodes.select("node", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    found = written(bands.join(shared, "key"), "buckets")
    draw = [F.xxhash64("key", "node", F.lit(i)) for i in range(PIVOTS)]
    drawn = found.groupBy("key").agg(*[F.min(h).alias(f"h{i}") for i, h in enumerate(draw)])
    is_drawn = [F.col(f"h{i}") == h for i, h in enumerate(draw)]
    out = written(found.join(drawn, "key").select("key", "node", "size", F.greatest(*is_drawn).alias("head"), is_drawn[0].alias("first")), "members")
    dropped(found)
    return out


def _likely(near: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, j), one of each node: of those whose estimate says that they are linked, that with the partner of the smallest hash, so that nodes meet in the same ones."""
    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "j"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "j"))).alias("e")).select("e.*")
    best = ends.groupBy("node").agg(F.min(F.struct((F.col("j") < percent / 100).alias("under"), F.xxhash64("other").alias("h"), "other")).alias("m"))
    return _ordered(best.select(F.col("node").alias("a"), F.col("m.other").alias("b")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-5, margin: float = 0.16, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), group: str | None = None) -> DataFrame:
    """Groups documents whose sets of ``words``-word shingles have 100 * intersection >= percent * union, and what these links reach.

    A-Z are lowered; words are runs of characters other than U+0020 and U+0009 to U+000D. Returns per row: doc_id,
    n_shingles, component_id (the smallest doc_id reachable, itself included) and kept (doc_id = component_id). A pair at
    the threshold shares no band with a probability of ``miss`` at most; a candidate goes to the exact check if its
    likelihood estimate is within ``margin`` (seven standard deviations at 256 registers) of the threshold.

    Nulls: a null text is empty; an empty text has an empty set and is linked with nothing; a row with a null doc_id
    groups like any other, and only a group of none but such rows has a null component_id. Repeated rows: each comes
    back; rows that repeat a doc_id with the same text share its component. Ties: the smallest doc_id is kept. Fewer
    words than ``words``: the whole sequence is the one shingle. An empty table gives no rows. Columns
    named in ``keep`` come along as strings; others are ignored. A name in ``group`` adds a column of that name with the
    group's own key, a long that groups with equal or null ids do not share; it is null for an empty set.

    The result is a table in the shared folder; all others that are made on the way are deleted.
    """
    short_batches(docs.sparkSession)
    own = [F.col(c).cast("string").alias(f"__{c}") for c in keep]
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), null_safe_text(text).alias("text"), *own)
    base = written(_sketched(docs, words, [f"__{c}" for c in keep]), "sketches")
    docs = docs.select("doc_id", "text")
    # texts of one set are one node, named by its first row
    reps = written(base.filter("s0 is not null").groupBy("s0", "s1").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "texts")
    nodes = written(base.join(reps.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "regs", *BITS), "nodes")
    members = _members(nodes, percent, miss)

    # members meet their bucket's pivots; the bitmaps of both let through what can be a link and little else
    wide = members.join(nodes.drop("regs"), "node")
    met = _side(wide, "b", "key").join(_side(wide.filter("head"), "a", "key"), "key").filter((F.col("a") != F.col("b")) & can_link(percent))
    pairs = written(_ordered(met), "pairs")
    near = written(_estimated(pairs, nodes, percent, margin), "candidates")
    likely = written(_likely(near, percent), "likely")
    edges = _verified(likely, docs, reps, words, percent)
    label = components(edges)
    dropped(edges)
    rest = written(_across(near.select("a", "b").join(likely, ["a", "b"], "left_anti"), label).select("a", "b"), "rest")
    dropped(likely, near)
    label = _joined(label, _verified(rest, docs, reps, words, percent))

    # what is left: members of a bucket that are not in its main component, each with all of another component
    at = members.filter("size > 2").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ends = at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.when(F.col("first"), F.col("comp"))).alias("main")).filter("low < high").select("key", "main")
    at = written(at.select("key", "node", "comp").join(ends, "key").join(nodes.drop("regs"), "node"), "open")
    left = _side(at.filter("comp <> main").withColumn("ca", F.col("comp")), "a", "key", "ca").alias("l")
    other = _side(at.withColumn("cb", F.col("comp")), "b", "key", "cb").alias("o")
    fresh = _ordered(left.join(other, (F.col("l.key") == F.col("o.key")) & (F.col("ca") != F.col("cb")) & can_link(percent)))
    fresh = written(fresh.join(pairs, ["a", "b"], "left_anti"), "fresh")
    dropped(members, pairs, rest, at)
    near = written(_estimated(fresh, nodes, percent, margin).select("a", "b"), "candidates")
    dropped(fresh, nodes)
    label = _joined(label, _verified(near, docs, reps, words, percent))

    named = reps.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(names, "comp").select("s0", "s1", "comp", "component_id")
    rows = base.select("doc_id", F.col("n").alias("n_shingles"), "s0", "s1", *[F.col(f"__{c}").alias(c) for c in keep]).join(named, ["s0", "s1"], "left")
    rows = rows.withColumn("component_id", F.when(F.col("s0").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    rows = rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    out = written(rows.select("doc_id", "n_shingles", *keep, *([F.col("comp").alias(group)] if group else []), "component_id", "kept"), "groups")
    dropped(base, reps, label, near)
    return out


def op4_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    """The groups over three-word shingles at a similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
