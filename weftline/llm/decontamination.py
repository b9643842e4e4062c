"""Passages of a benchmark in documents: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact check.

All of it is DataFrame functions. A window's features are its word shingles that occur in some item, each weighted by how
few items have it; shingles that no item has weigh nothing in a fingerprint, so windows without any have no fingerprint
and no row. The exact check afterwards counts every shingle of the window. A shingle knows the sizes of the items that
have it, so windows are made of sizes that can pass, and windows of one fingerprint meet the index once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.plans.tables import written

from .shared import null_safe_text

#: Bits of a fingerprint's blocks, and how far two fingerprints are compared: of six blocks, one differs by 2 bits at most
#: if all differ by 17. An index over more rows than this is joined by shuffle, not broadcast.
BLOCKS, RADIUS, BROADCAST_ROWS = (11, 11, 11, 11, 10, 10), 17, 500_000
#: What separates words, and the same for a text of ASCII in lower case, where plain ranges take less time.
SEPARATORS, ASCII_SEPARATORS = r"[^\p{L}\p{N}]+", "[^a-z0-9]+"
LANES = 0x0000000100000001


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script; an empty text has none."""
    low = F.lower(text)
    return F.array_remove(F.when(F.octet_length(low) == F.length(low), F.split(low, ASCII_SEPARATORS)).otherwise(F.split(low, SEPARATORS)), "")


def _shingles(docs: DataFrame, keep: list[str], size: int) -> DataFrame:
    """One row per position: the columns in ``keep``, n (words), pos (from 0), sh (a 64-bit hash of ``size`` words; of a shorter text, of all)."""
    at = docs.select(*keep, words_of(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    rows = at.select(*keep, "n", "w", F.posexplode("w").alias("pos", "word")).filter((F.col("pos") <= F.col("n") - size) | (F.col("n") < size) & (F.col("pos") == 0))
    return rows.select(*keep, "n", "pos", F.xxhash64(*[F.coalesce(F.get("w", F.col("pos") + k), F.lit("")) for k in range(size)]).alias("sh"))


def fingerprint(features: Column) -> Column:
    """The 64-bit SimHash of an array of structs (sh long, wt long): a bit is set where features that have it hold over half the weight.

    Votes for bits b and b + 32 are counted in the two halves of one long, in one pass over the features.
    """
    start = F.struct(F.lit(0).cast("long").alias("all"), *[F.lit(0).cast("long").alias(f"v{b}") for b in range(32)])
    add = lambda a, x: F.struct(
        (a["all"] + x["wt"]).alias("all"),
        *[(a[f"v{b}"] + F.shiftrightunsigned(x["sh"], b).bitwiseAND(F.lit(LANES)) * x["wt"]).alias(f"v{b}") for b in range(32)],
    )

    def bits(v: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(32):
            low = v[f"v{b}"].bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > v["all"]
            high = F.shiftrightunsigned(v[f"v{b}"], 32) * 2 > v["all"]
            out = out + F.when(low, F.lit(1 << b)).otherwise(F.lit(0)) + F.when(high, F.lit((1 << (b + 32)) - (1 << 64 if b == 31 else 0))).otherwise(F.lit(0).cast("long"))
        return out

    return F.aggregate(features, start, add, bits)


def _blocks(fp: str) -> list[Column]:
    """The blocks of a fingerprint, lowest bits first."""
    at = [sum(BLOCKS[:b]) for b in range(len(BLOCKS))]
    return [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1)) for lo, width in zip(at, BLOCKS, strict=True)]


def _neighbours(width: int, most: int) -> list[int]:
    """All masks of up to ``most`` of ``width`` bits."""
    return [sum(1 << i for i in c) for k in range(most + 1) for c in itertools.combinations(range(width), k)]


def _weight(features: Column | str) -> Column:
    return F.aggregate(features, F.lit(0).cast("long"), lambda t, x: t + x["wt"])


def _profiles(benchmark: DataFrame, words: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Of items (item_id, text): their profiles, the vocabulary of their shingles, their number, and the weight of a shingle that one item has.

    A profile is item (a row's number), item_id, size in words, own (its shingles with weights), weight and fp. The
    vocabulary is sh, wt and sizes, those of the items that have it.
    """
    items = benchmark.withColumn("item", F.monotonically_increasing_id())
    own = written(_shingles(items, ["item_id", "item"], words).dropDuplicates(["item", "sh"]), "items")
    n = own.select("item").distinct().count()
    rare = max(1, round(16 * (1 + math.log(max(n, 1)))))
    weigh = F.round(16 * (1 + F.log(F.lit(float(max(n, 1))) / F.count(F.lit(1))))).cast("long")
    vocabulary = written(own.groupBy("sh").agg(weigh.alias("wt"), F.sort_array(F.collect_set("n")).alias("sizes")), "vocabulary")
    profile = own.join(vocabulary, "sh").groupBy("item", "item_id", "n").agg(F.sort_array(F.collect_list(F.struct("sh", "wt"))).alias("own"), F.sum("wt").alias("weight"))
    profile = written(profile.select("item", "item_id", F.col("n").alias("size"), "own", "weight", fingerprint(F.col("own")).alias("fp")), "profiles")
    return profile, vocabulary, n, rare


def _windows(hits: DataFrame, least: list[tuple[int, int]], words: int, percent: int, rare: int) -> DataFrame:
    """Windows that can pass: doc_id, row, size, pos, set (its shingles of items), weight.

    From (doc_id, row, n, pos, sh, wt, sizes), a row per shingle of an item in a document; ``least``: item sizes with the
    least weight of their items. What a window has in common with an item of its size are shingles that items of this
    size have; these must weigh ``percent`` of the item and of the window.
    """
    ahead = W.partitionBy("row").orderBy("pos").rangeBetween(0, max(s for s, _ in least) - 1)
    bounds = F.create_map(*[F.lit(x) for s, w in least for x in (s, w)])
    at = hits.select("doc_id", "row", "n", "pos", F.collect_list(F.struct("pos", "sh", "wt", "sizes")).over(ahead).alias("f"))
    at = at.select("doc_id", "row", "n", "pos", "f", F.explode(F.array_distinct(F.flatten(F.transform("f", lambda x: x["sizes"])))).alias("size"))
    inside = F.filter("f", lambda x: x["pos"] <= F.col("pos") + F.greatest(F.col("size") - words, F.lit(0)))
    at = at.select(
        "doc_id", "row", "size", F.greatest(F.least("pos", F.col("n") - F.col("size")), F.lit(0)).alias("pos"),
        F.greatest(F.least("size", "n") - words + 1, F.lit(1)).alias("count"), inside.alias("f"),
    )
    alike = F.filter("f", lambda x: F.array_contains(x["sizes"], F.col("size")))
    at = at.filter(100 * _weight(alike) >= percent * F.element_at(bounds, F.col("size")))
    bare = lambda f: F.array_distinct(F.transform(f, lambda x: F.struct(x["sh"].alias("sh"), x["wt"].alias("wt"))))
    at = at.select("doc_id", "row", "size", "pos", bare("f").alias("set"), _weight(bare(alike)).alias("alike"), (rare * (F.col("count") - F.size("f"))).alias("other"))
    at = at.select("doc_id", "row", "size", "pos", "set", "alike", (_weight("set") + F.col("other")).alias("weight"))
    return at.filter((100 * F.col("alike") >= percent * F.element_at(bounds, F.col("size"))) & (100 * F.col("alike") >= percent * F.col("weight"))).drop("alike")


def candidates(window: DataFrame, profile: DataFrame, items: int, radius: int) -> DataFrame:
    """Distinct (size, fp, item): fingerprints of ``window`` with the items of the same size within ``radius`` bits; none is missed.

    The index has each block of each item with all values up to radius // blocks bits away. Equal fingerprints, as a
    passage that many documents share has them, are one row here.
    """
    masks = [_neighbours(width, radius // len(BLOCKS)) for width in BLOCKS]
    values = F.array(*[F.transform(F.array(*[F.lit(m).cast("long") for m in own]), b.bitwiseXOR) for b, own in zip(_blocks("item_fp"), masks, strict=True)])
    keys = profile.select("item", "size", F.col("fp").alias("item_fp")).select("item", "size", "item_fp", F.posexplode(values).alias("block", "values")).select("item", "size", "item_fp", "block", F.explode("values").alias("value"))
    near = F.broadcast if items * sum(map(len, masks)) <= BROADCAST_ROWS else (lambda df: df)
    asked = window.select("size", "fp").distinct().select("size", "fp", F.posexplode(F.array(*_blocks("fp"))).alias("block", "value"))
    met = asked.join(near(keys), ["size", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    return met.select("size", "fp", "item").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", row: str | None = None) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, pos (the window's first word) and similarity, of the most similar window.

    A window has as many words as the item, or is the whole document where that has fewer. Similarity is weighted Jaccard
    over the ``words``-word shingles of lower-case words: a shingle weighs 1 + ln(items / items that have it), in 16ths;
    one that no item has weighs as one that a single item has, each time it occurs. Reported from ``percent`` on.

    A window begins at a shingle of some item: one that begins before has the same shingles of items as the one that
    begins at the first of them. Windows whose shingles of items of that size weigh less than ``percent`` of the lightest
    such item, or of the window, cannot pass and have no fingerprint. Fingerprints are compared through blocks (``BLOCKS``):
    if two are within ``radius`` bits, some block is within radius // blocks bits, and the index holds every block's
    neighbours so far away, so none is missed.

    Nulls and empty texts hold nothing, and an item without words is held by nothing. A text of fewer than ``words`` words
    is one shingle, so an item of fewer words is held by texts that consist of it. Repeated documents each come back;
    repeated item texts come back under each item_id. Ties between windows go to the first. Empty tables give no rows. A
    column named in ``row``, which tells the rows of ``docs`` apart, comes along as a string; others are ignored.
    """
    profile, vocabulary, n, rare = _profiles(benchmark.select(F.col(item_id).cast("long").alias("item_id"), null_safe_text(item_text).alias("text")), words)
    # as many rows as there are lengths of items
    least = [(r["size"], r["least"]) for r in profile.groupBy("size").agg(F.min("weight").alias("least")).orderBy("size").collect()]
    if not least:
        return docs.limit(0).select(*([row] if row else []), F.col(doc_id).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("pos"), F.lit(0.0).alias("similarity"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), null_safe_text(text).alias("text"), (F.col(row) if row else F.monotonically_increasing_id()).cast("string").alias("row"))
    near = F.broadcast if vocabulary.count() <= BROADCAST_ROWS else (lambda df: df)
    hits = written(_shingles(rows, ["doc_id", "row"], words).join(near(vocabulary), "sh").select("doc_id", "row", "n", "pos", "sh", "wt", "sizes"), "hits")
    window = written(_windows(hits, least, words, percent, rare).withColumn("fp", fingerprint(F.col("set"))), "windows")
    index = profile.select("item", "item_id", "own", F.col("weight").alias("item_weight"))
    pair = window.join(candidates(window, profile, n, radius), ["size", "fp"]).join(index, "item")
    pair = pair.withColumn("both", _weight(F.array_intersect("set", "own"))).withColumn("all", F.col("weight") + F.col("item_weight") - F.col("both"))
    pair = pair.filter(100 * F.col("both") >= percent * F.col("all"))
    best = pair.groupBy("doc_id", "row", "item", "item_id").agg(F.max(F.struct((F.col("both") / F.col("all")).alias("similarity"), (-F.col("pos")).alias("back"))).alias("best"))
    return best.select(*([F.col("row").alias(row)] if row else []), "doc_id", "item_id", (-F.col("best.back")).alias("pos"), F.col("best.similarity").alias("similarity"))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
