"""WARC records and their fixity: Merkle trees over records and offset ranges, compared from the root down.

A replica's records are placed in the ranges of keys that the archive's own index gives, so a record that one of them
lacks moves no other. Only branches that differ are opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.plans.tables import dropped, written

from .shared import short_batches

#: Children of a tree's node, records of a volume.
FAN, VOLUME = 16, 256


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC 1.0 record of a page, as text. The record's id is from the page's, its date fixed, so that replicas agree."""
    body = F.coalesce(html, F.lit(""))
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), dashed, F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def ranked(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with ``rank``, 0 on, in the order of ``by``: a range sort whose partitions are counted, without one task for all rows."""
    at = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__p", F.monotonically_increasing_id()), "ranked")
    parts = at.groupBy(F.shiftright("__p", 33).alias("__part")).count().orderBy("__part").collect()  # a row per partition
    offsets = np.cumsum([0, *(r["count"] for r in parts)]).tolist()
    before = df.sparkSession.createDataFrame([(r["__part"], o) for r, o in zip(parts, offsets[:-1], strict=True)], "__part long, __before long")
    at = at.withColumn("__part", F.shiftright("__p", 33)).join(F.broadcast(before), "__part")
    return at.withColumn("rank", F.col("__before") + F.col("__p").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__part", "__before")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, sha256, length in bytes and copies of the distinct WARC records of pages. Texts do not move, and copies are counted before they do.

    A null url or html is empty, a null page_id is kept; repeated rows are copies. An empty table gives no rows. Other columns are ignored.
    """
    text = record(F.col(page_id).cast("long"), F.col(url), F.col(html))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), text.alias("r")).select("page_id", F.sha2("r", 256).alias("sha256"), F.octet_length("r").cast("long").alias("length"))
    return rows.groupBy("page_id", "sha256", "length").agg(F.count(F.lit(1)).alias("copies"))


def volumes(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The index of an archive: page_id, rank, volume, leaf, start (in the volume), length, copies and sha256 of each distinct record.

    Records are in the order of page_id, then digest; copies of a record follow each other, and each ``VOLUME`` distinct
    records are a volume, so a page_id that holds many rows fills many volumes.

    Nulls: a null page_id sorts first, a null url or html is empty. Repeated rows are copies of one record. Ties cannot
    be, as records are distinct. Empty and very long pages are records like any other. An empty table gives no rows.
    Other columns are ignored.
    """
    at = ranked(records(pages, page_id, url, html), ["page_id", "sha256"])
    at = at.withColumn("volume", F.floor(F.col("rank") / VOLUME)).withColumn("leaf", (F.col("rank") % VOLUME).cast("int"))
    start = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(W.partitionBy("volume").orderBy("leaf").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return at.select("page_id", "rank", "volume", "leaf", start.alias("start"), "length", "copies", "sha256")


def placed(found: DataFrame, index: DataFrame) -> DataFrame:
    """``found`` (as ``records`` gives it) with ``slot``: the last one of the index whose first record is not behind; 0 before all.

    Nulls sort first, as in the index; an empty index has slot 0 alone, and an empty ``found`` gives no rows. Repeated rows stay.
    Both are sorted together by range, and each partition carries the slot on; what begins a partition takes the last slot
    of those before.
    """
    short_batches(found.sparkSession)
    none = F.lit(None)
    firsts = index.filter(F.col("rank") % FAN == 0).select("page_id", "sha256", none.cast("long").alias("length"), none.cast("long").alias("copies"), F.floor(F.col("rank") / FAN).alias("slot"))
    both = firsts.union(found.select("page_id", "sha256", "length", "copies", none.cast("long").alias("slot"))).withColumn("late", F.col("slot").isNull())

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = -1, TaskContext.get().partitionId()
        for t in batches:
            slot = np.maximum.accumulate(np.append(last, t.column(4).fill_null(-1).to_numpy()))[1:]
            last = int(slot[-1]) if len(slot) else last
            yield pa.RecordBatch.from_arrays([*t.columns[:4], pa.array(slot), pa.array(np.full(t.num_rows, part))], names=["page_id", "sha256", "length", "copies", "slot", "part"])

    key = ["page_id", "sha256", "late"]
    at = written(both.repartitionByRange(*key).sortWithinPartitions(*key).drop("late").mapInArrow(carry, "page_id long, sha256 string, length long, copies long, slot long, part long"), "placed")
    parts = at.groupBy("part").agg(F.max("slot").alias("last")).orderBy("part").collect()  # a row per partition
    lasts = np.maximum.accumulate([0, *(r["last"] for r in parts)]).tolist()
    before = found.sparkSession.createDataFrame([(r["part"], x) for r, x in zip(parts, lasts[:-1], strict=True)], "part long, before long")
    at = at.filter("copies is not null").join(F.broadcast(before), "part")
    return at.select("page_id", "sha256", "length", "copies", F.greatest("slot", "before").alias("slot"))


def tree(placed: DataFrame, last: int) -> list[DataFrame]:
    """The levels of a Merkle tree over the records of slots 0 to ``last``, slots first and one root at the end: node, hash, bytes. Each is written.

    A slot hashes its records in order, each with its place in bytes, counted from the slot's first so that what one slot
    lacks moves no other. An index has ``FAN`` records in a slot at most; a replica's slot of more equals none of its, so
    only their number and bytes are hashed, and they never meet in a row. Another node hashes its children's hashes and
    numbers of bytes in order, and with these their offset ranges. A null page_id counts as the mark of none.
    """
    size = F.col("length") * F.col("copies")
    count = placed.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    full = count.filter(F.col("n") > FAN).select("slot", F.sha2(F.concat_ws(":", F.lit("more"), "n", "bytes"), 256).alias("hash"), "bytes")
    some = placed.join(full.select("slot"), "slot", "left_anti").groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("page_id", "sha256", "length", "copies"))).alias("c"), F.sum(size).alias("bytes"))
    start = lambda c, i: F.aggregate(F.slice(c, 1, i), F.lit(0).cast("long"), lambda t, x: t + x["length"] * x["copies"])
    told = F.transform("c", lambda x, i: F.concat_ws(":", start(F.col("c"), i), x["length"], x["copies"], x["sha256"], F.coalesce(x["page_id"].cast("string"), F.lit("-"))))
    some = some.select("slot", F.sha2(F.array_join(told, ","), 256).alias("hash"), "bytes")
    out = [written(some.union(full).withColumnRenamed("slot", "node"), "slots")]
    while last > 0:
        last //= FAN
        children = F.sort_array(F.collect_list(F.struct("node", "hash", "bytes")))
        up = out[-1].groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(children.alias("c"), F.sum("bytes").alias("bytes"))
        told = F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["node"], c["hash"], c["bytes"])), ",")
        out.append(written(up.select(F.col("up").alias("node"), F.sha2(told, 256).alias("hash"), "bytes"), "nodes"))
    return out


def descend(ours: list[DataFrame], theirs: list[DataFrame]) -> list[DataFrame]:
    """The nodes (``up``) that differ between two trees, the roots first and slots last. A node is compared only if the one above it differs; each level is written."""
    opened: list[DataFrame] = []
    for own, other in reversed(list(zip(ours, theirs, strict=True))):
        if opened:
            own, other = (x.join(opened[-1], F.floor(x["node"] / FAN) == opened[-1]["up"], "left_semi") for x in (own, other))
        both = own.alias("a").join(other.alias("b"), "node", "full").filter(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        opened.append(written(both.select(F.col("node").alias("up")), "mismatches"))
    return opened


def audit(index: DataFrame, replica: DataFrame) -> DataFrame:
    """Where the records of a replica (as ``records`` gives them) differ from an index: page_id, sha256, length, copies, slot and status.

    The one root is compared first. Below a node, its children are compared only if it differs, and records only in slots that
    differ. Status: missing, where the replica lacks a record; corrupt, where it has others under the page_id instead;
    extra, of the replica's other records. ``copies`` is how many of them. Where one page_id has several such records,
    all that are lacking are corrupt if any other is there.
    """
    ours = index.select("page_id", "sha256", "length", "copies", F.floor(F.col("rank") / FAN).alias("slot"))
    theirs = placed(replica, index)
    last = ours.agg(F.max("slot")).first()[0] or 0
    trees = tree(ours, last), tree(theirs, last)
    *above, open_ = descend(*trees)
    dropped(*above, *trees[0], *trees[1])
    own, other = (x.join(open_, x["slot"] == open_["up"], "left_semi").alias(c) for x, c in ((ours, "a"), (theirs, "b")))
    same = F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.sha256") == F.col("b.sha256")) & (F.col("a.length") == F.col("b.length")) & (F.col("a.slot") == F.col("b.slot"))
    more = F.coalesce("a.copies", F.lit(0)) - F.coalesce("b.copies", F.lit(0))
    pick = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("page_id", "sha256", "length", "slot")]
    odd = written(own.join(other, same, "full").select(*pick, more.alias("more")).filter("more <> 0"), "differences")
    lacking, unknown = odd.filter("more > 0"), odd.filter("more < 0")
    ids = lambda df: df.select(F.col("page_id").alias("id")).distinct().withColumn("known", F.lit(True))
    named = lacking.join(ids(unknown), F.col("page_id").eqNullSafe(F.col("id")), "left").withColumn("status", F.when(F.col("known"), "corrupt").otherwise("missing"))
    extra = unknown.join(ids(lacking), F.col("page_id").eqNullSafe(F.col("id")), "left_anti").withColumn("status", F.lit("extra"))
    columns = ["page_id", "sha256", "length", F.abs("more").alias("copies"), "slot", "status"]
    return named.select(*columns).union(extra.select(*columns))


def fixity(index: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of ``index`` with its status in a replica's records (ok, corrupt or missing), and the replica's extra records, without leaf and start.

    ``index`` is as ``volumes`` gives it, ``replica`` as ``records`` does. A record of which only some copies are there
    has the status of those that are not. Nulls, repeated rows and empty tables as there; with an empty index all is extra, in volume 0.
    """
    found = written(audit(index, replica), "findings")
    bad = found.filter("status <> 'extra'").select(F.col("page_id").alias("id"), F.col("sha256").alias("digest"), "status")
    own = index.join(bad, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha256") == F.col("digest")), "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    none = F.lit(None)
    extra = found.filter("status = 'extra'").withColumn("volume", F.floor(F.col("slot") / (VOLUME // FAN))).withColumn("leaf", none.cast("int")).withColumn("start", none.cast("long"))
    columns = ["page_id", "volume", "leaf", "start", "length", "copies", "sha256", "status"]
    return own.select(*columns).union(extra.select(*columns))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica's pages as a test of audits. In every eighth block of 1024 ids, of 256 ids about one is lost, three have other texts, and one is there under another id, too."""
    h = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2), 16, 10).cast("int")
    at = pages.select("page_id", "url", "html", F.when((F.col("page_id") >= 0) & (F.floor(F.col("page_id") / 1024) % 8 == 0), h).otherwise(255).alias("h"))
    kept = at.filter("h is null or h <> 0").select("page_id", "url", F.when(F.col("h").between(1, 3), F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html")).alias("html"))
    return kept.union(at.filter("h = 4").select(-1 - F.col("page_id"), "url", "html"))


def op7_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica that lacks some, has some damaged and some of its own."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return fixity(written(volumes(pages), "volumes"), records(damaged(pages)))


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, url, html, CASE WHEN page_id >= 0 AND (page_id // 1024) % 8 = 0 THEN h END AS h FROM (SELECT *, ('0x' || substr(md5(page_id::VARCHAR), 1, 2))::INTEGER AS h FROM pages)
), both_ AS (
  SELECT 0 AS side, page_id, url, html, h FROM p UNION ALL SELECT 1, -1 - page_id, url, html, h FROM p WHERE h = 4
), r AS (
  SELECT side, page_id, md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS i, coalesce(url, '') AS url, coalesce(html, '') AS html, h FROM both_
), t AS (
  SELECT side, page_id, h, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || substr(i, 1, 8) || '-' || substr(i, 9, 4) || '-' || substr(i, 13, 4) || '-' || substr(i, 17, 4) || '-' || substr(i, 21, 12)
    || '>' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10)
    || html || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM r
), k AS (
  SELECT side, page_id, sha256(r) AS sha256, strlen(r)::BIGINT AS length, h, count(*) AS copies FROM t GROUP BY ALL
), x AS (
  SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, sha256) - 1 AS rank FROM k WHERE side = 0
)
SELECT page_id, rank // 256 AS volume, (rank % 256)::INTEGER AS leaf,
  coalesce(sum(length * copies) OVER (PARTITION BY rank // 256 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  length, copies, sha256, CASE WHEN h = 0 THEN 'missing' WHEN h BETWEEN 1 AND 3 THEN 'corrupt' ELSE 'ok' END AS status FROM x
UNION ALL SELECT page_id, 0, NULL, NULL, length, copies, sha256, 'extra' FROM k WHERE side = 1
"""
