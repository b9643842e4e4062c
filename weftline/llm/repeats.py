"""Runs (maximal periodic stretches) of words, by the linear tandem-repeat method of Gusfield and Stoye.

Of a sequence of word numbers: the blocks of its Lempel-Ziv factorisation give squares that cover the leftmost occurrence
of every kind of square; walks along suffix links of its suffix tree complete the vocabulary of primitively rooted ones;
their occurrences, which are leaves below their places in the tree, merge into runs where they follow each other.

Python workers see whole texts, one at a time. Only stretches of a text that can hold a run come to the tree: all words of
a run of ``LEAST`` words are in repeated groups of ``LEAST // 2`` words that lie near enough to each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import null_safe_text, short_batches, slices

#: Words of a run at least; also twice its period.
LEAST = 12
_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(1, LEAST // 2 + 1)]


class Factors:
    """Names of all factors of lengths that are powers of two: equal factors have equal names. They answer what extends how far, and the last are ranks of suffixes."""

    def __init__(self, s: np.ndarray) -> None:
        self.n = n = len(s)
        name = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.levels, width = [], 1
        while True:
            self.levels.append(np.append(name, -1).astype(np.int32))
            if n < 2 or name.max() == n - 1:
                break
            behind = np.zeros(n, np.int64)
            behind[: max(0, n - width)] = name[width:] + 1
            name = np.unique(name * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
            width *= 2
        self.rank = name

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that begins at i and at j, which differ."""
        i, j, far = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i, j, far = i + step, j + step, far + step
        return far

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that ends at i and at j, which differ; 0 where one is -1."""
        i, j, far = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            fits = np.minimum(a, b) >= 0
            step = (fits & (self.levels[k][np.where(fits, a, 0)] == self.levels[k][np.where(fits, b, 0)])).astype(np.int64) << k
            i, j, far = i - step, j - step, far + step
        return far


def blocks(f: Factors, order: np.ndarray) -> np.ndarray:
    """Bounds of the Lempel-Ziv blocks: each is the longest factor that also begins earlier, or a word that is new."""
    n = f.n
    rank, before, after = f.rank.tolist(), [-1, *order[:-1].tolist()], [*order[1:].tolist(), -1]
    left, right = [-1] * n, [-1] * n
    for i in range(n - 1, -1, -1):  # of the suffixes that begin earlier, the nearest in order
        r = rank[i]
        a, b = left[i], right[i] = before[r], after[r]
        if a >= 0:
            after[rank[a]] = b
        if b >= 0:
            before[rank[b]] = a
    at, far = np.arange(n), np.zeros(n, np.int64)
    for other in (np.array(left), np.array(right)):
        has = np.flatnonzero(other >= 0)
        far[has] = np.maximum(far[has], f.ahead(at[has], other[has]))
    far, bounds = np.maximum(far, 1).tolist(), [0]
    while bounds[-1] < n:
        bounds.append(bounds[-1] + far[bounds[-1]])
    return np.array(bounds)


def _each(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every k from 1 to count: which entry it belongs to, and k."""
    own = np.repeat(np.arange(len(lo)), count)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + 1


def _primitive(f: Factors, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the squares of ``period`` at ``at`` have roots that are no powers."""
    least = np.arange(int(period.max(initial=1)) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            some = least[p * p :: p]
            some[some == np.arange(p * p, len(least), p)] = p
    good, rest = np.ones(len(at), bool), period.copy()
    while (on := np.flatnonzero(rest > 1)).size:
        p = least[rest[on]]
        d = period[on] // p
        good[on] &= f.ahead(at[on], at[on] + d) < 2 * period[on] - d
        while (more := rest[on] % p == 0).any():
            rest[on] = np.where(more, rest[on] // p, rest[on])
    return good


def covering_squares(f: Factors, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of squares of which every kind has one at the start of its leftmost occurrence or before it in the same run. Powers of shorter roots are left out, as are then their rotations."""
    h, h1 = bounds[:-1], bounds[1:]
    h2 = np.append(bounds[2:], f.n)
    name = f.levels[0]
    own, k = _each(h, np.where(h1 < f.n, h1 - h, 0))  # begins in a block, and goes on in the next
    on = name[h1[own]] == name[h1[own] - k]
    k, at = k[on], h1[own[on]]
    q = at - k
    ahead, back = f.ahead(at, q), f.back(at - 1, q - 1)
    good = ahead + back >= k
    starts, lengths = [np.maximum(q - back, q - k + 1)[good]], [2 * k[good]]
    own, k = _each(h, np.where(h > 0, np.minimum(h2 - h, f.n - 1 - h), 0))  # begins before a block, and has its middle in it
    on = (name[h[own]] == name[h[own] + k]) & (name[h[own] - 1] == name[h[own] + k - 1])
    own, k = own[on], k[on]
    at = h[own]
    ahead, back = f.ahead(at, at + k), f.back(at - 1, at + k - 1)
    start = np.maximum(at - back, at - k + 1)
    good = (ahead + back >= k) & (start + k <= h1[own])
    start, length = np.concatenate([*starts, start[good]]), np.concatenate([*lengths, 2 * k[good]])
    good = _primitive(f, start, length // 2)
    return start[good], length[good]


class Tree:
    """The suffix tree: leaf i is the suffix at i, inner nodes follow. ``depth`` counts an end mark of its own behind the last word."""

    def __init__(self, s: np.ndarray, f: Factors, order: np.ndarray) -> None:
        n = len(s)
        self.s, self.order, self.n = s.tolist(), order.tolist(), n
        common = [0, *f.ahead(order[:-1], order[1:]).tolist()]
        depth, up = list(range(n + 1, 1, -1)), [n] * n
        left, right = f.rank.tolist(), f.rank.tolist()
        depth.append(0), up.append(n), left.append(0), right.append(n - 1)
        path = [n]
        for r, i in enumerate(self.order):
            h, last = common[r], -1
            while depth[path[-1]] > h:
                v = path.pop()
                right[v] = r - 1
                if last >= 0:
                    up[last] = v
                last = v
            if last >= 0:
                if depth[path[-1]] < h:
                    path.append(len(depth))
                    depth.append(h), up.append(n), left.append(left[last]), right.append(n - 1)
                up[last] = path[-1]
            path.append(i)
        for v, above in zip(path[:0:-1], path[-2::-1], strict=True):
            up[v], right[v] = above, n - 1
        self.root, self.depth, self.up, self.left, self.right = n, depth, up, left, right
        self.many = max(self.s, default=0) + 1
        v = np.arange(len(depth))
        v = v[v != n]
        over = np.array(up)[v]
        first = order[np.array(left)[v]] + np.array(depth)[over]
        inside = first < n  # others go on with the end mark
        self.child = dict(zip((over[inside] * self.many + s[first[inside]]).tolist(), v[inside].tolist(), strict=True))
        self.links = {n: n}

    def places(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The nodes at or below the ends of factors: the highest ancestors of leaves that are as deep."""
        depth, jumps = np.array(self.depth), [np.array(self.up)]
        while (jumps[-1] != self.root).any():
            jumps.append(jumps[-1][jumps[-1]])
        v = start
        for j in reversed(jumps):
            v = np.where(depth[j[v]] >= length, j[v], v)
        return v

    def link(self, v: int) -> int:
        """The node of a node's words without the first."""
        links, chain = self.links, []
        while v not in links:
            chain.append(v)
            v = self.up[v]
        for v in reversed(chain):
            links[v] = self.down(links[self.up[v]], self.order[self.left[v]] + 1, self.depth[v] - 1)
        return links[chain[0] if chain else v]

    def down(self, v: int, at: int, length: int) -> int:
        """The node at or below the end of the factor of ``length`` at ``at``, from one on its path."""
        while self.depth[v] < length:
            v = self.child[v * self.many + self.s[at + self.depth[v]]]
        return v

    def squares(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node and length of every kind of square: those given, and what walks by suffix links find: a square without its first word, if that word can follow."""
        s, depth, seen, nodes, lengths = self.s, self.depth, set(), [], []
        for v, size in zip(self.places(start, length).tolist(), length.tolist(), strict=True):
            while (v, size) not in seen:
                seen.add((v, size))
                nodes.append(v), lengths.append(size)
                i = self.order[self.left[v]]
                w = self.down(self.link(self.up[v]), i + 1, size - 1)
                if depth[w] == size - 1:
                    w = self.child.get(w * self.many + s[i])
                    if w is None:
                        break
                else:
                    at = self.order[self.left[w]] + size - 1
                    if at >= self.n or s[at] != s[i]:
                        break
                v = w
        return np.array(nodes, np.int64), np.array(lengths, np.int64)


def runs(s: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of small numbers, of ``least`` members or more, by start, then period."""
    if len(s) < 2:
        return []
    f = Factors(s)
    order = np.argsort(f.rank)
    tree = Tree(s, f, order)
    nodes, lengths = tree.squares(*covering_squares(f, blocks(f, order)))
    if not len(nodes):
        return []
    left, right, period = np.array(tree.left)[nodes], np.array(tree.right)[nodes], lengths // 2
    own, k = _each(left, right - left + 1)
    all_ = np.sort(period[own] * (f.n + 1) + order[left[own] + k - 1])
    first = np.flatnonzero(np.diff(all_, prepend=-2) != 1)
    last = np.append(first[1:], len(all_)) - 1
    period, start = np.divmod(all_[first], f.n + 1)
    length = all_[last] - all_[first] + 2 * period
    return sorted((a, n, p) for a, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True) if n >= least)


def likely(h: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Bounds of the stretches, apart from each other, that can hold runs, from hashes of words.

    A run of n >= least words and period q <= n / 2 has n - q >= least / 2 words that come again q words on. So each of its
    words is in a group of least / 2 that occurs twice inside the run, at most q apart. What hashes take for equal only adds stretches.
    """
    size, found, todo = least // 2, [], [(0, len(h))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        x = h[lo:hi]
        g = x[: len(x) - size + 1] * _ODD[0]
        for j in range(1, size):
            g = g + x[j : len(x) - size + 1 + j] * _ODD[j]
        in_order = np.sort(g)
        if not (in_order[1:] == in_order[:-1]).any():
            continue
        o = np.argsort(g, kind="stable")
        near = np.flatnonzero((g[o[1:]] == g[o[:-1]]) & (o[1:] - o[:-1] <= (hi - lo) // 2))
        if not len(near):
            continue
        marks = np.zeros(len(x) + 1, np.int64)
        at = np.unique(np.concatenate([o[near], o[near + 1]]))
        marks[at] += 1
        marks[at + size] -= 1
        edge = np.diff((np.cumsum(marks)[:-1] > 0).astype(np.int8), prepend=0, append=0)
        some = list(zip((np.flatnonzero(edge == 1) + lo).tolist(), (np.flatnonzero(edge == -1) + lo).tolist(), strict=True))
        if some == [(lo, hi)]:
            found += some
        else:
            todo += some
    return sorted(found)


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """The runs of a text's words, by start, then period."""
    found = []
    for lo, hi in likely(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)):
        number: dict[bytes, int] = {}
        found += [(lo + a, n, p) for a, n, p in runs(np.array([number.setdefault(w, len(number)) for w in words[lo:hi]], np.int64))]
    return found


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which those of one document in ten repeat from some place on, as its id decides. A null id decides nothing."""
    h = None if doc_id is None else crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


_KINDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """Of each row of (doc_id, text): doc_id, n_runs, the longest run's start, length, period and exponent_milli, and digests of all runs and of the text without repeats.

    ``change`` makes other words of a text's words and its doc_id. Nulls: a null text is empty; a null doc_id is kept. Without a
    run the four numbers are null, and the digest of runs is that of no text. Of runs of one length the first counts, then
    that of the shortest period. Repeated rows come back as often. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_pylist([_row(d, (t or "").encode(), change) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], schema=_SCHEMA)

    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text")).mapInArrow(run, _KINDS)


_SCHEMA = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _KINDS.split(", ")])


def _row(doc_id: int | None, text: bytes, change) -> dict:
    words = text.split()
    words = change(words, doc_id) if change else words
    found = word_runs(words)
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = words
    if found:
        marks = np.zeros(len(words) + 1, np.int64)
        for a, n, q in found:
            marks[a + q] += 1
            marks[a + n] -= 1
        kept = [words[i] for i in np.flatnonzero(np.cumsum(marks)[:-1] == 0).tolist()]
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if found else None,
        "runs_sha256": hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(),
    }


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, of which one in ten is made to repeat itself."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_period)
