"""The link graph: edges, degrees, PageRank, hubs and authorities, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.plans.tables import dropped, written


def link_edges(links: DataFrame, items: DataFrame) -> DataFrame:
    """src, dst from (from_url, href) and (id, url): hrefs made absolute and resolved by normalised path and host; no loops, no repeats."""
    norm = lambda u: F.concat(F.lower(F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit(""))), urls.path(u))
    nodes = items.select("id", norm(F.col("url")).alias("n")).groupBy("n").agg(F.min("id").alias("id"))
    to = links.select(norm(F.col("from_url")).alias("f"), norm(urls.absolute(F.col("href"), F.col("from_url"))).alias("t"))
    both = to.join(nodes.select(F.col("n").alias("f"), F.col("id").alias("src")), "f").join(nodes.select(F.col("n").alias("t"), F.col("id").alias("dst")), "t")
    return both.filter("src <> dst").select("src", "dst").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree_in, degree_out of every node, zeros included. One aggregation of both ends."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))).unionAll(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").cast("long").alias("degree_in"), F.sum("o").cast("long").alias("degree_out"))


def _held(edges: DataFrame, by: str) -> DataFrame:
    """Edges, written and then held in memory by one of their ends: steps that join on it move no edge, and an executor's loss costs a read."""
    return written(edges, "links").repartition(by).persist()


def pagerank(nodes: DataFrame, edges: DataFrame, steps: int = 10, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """id, pagerank after ``steps`` steps from an even start; what dangling nodes hold is spread evenly.

    With ``tolerance`` it ends once a step changes all ranks by less in sum. Edges are dealt out by their source once, so a
    step shuffles ranks only. Each step is a table, so plans stay as they are.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = _held(edges.join(out, "src"), "src")
    base = written(nodes.select("id").join(out, F.col("id") == F.col("src"), "left").select("id", F.col("out").isNull().alias("loose")), "nodes")
    n = base.count()
    rank = written(base.select("id", "loose", F.lit(1.0 / max(n, 1)).alias("r")), "rank")
    for _ in range(steps):
        sent = links.join(rank.select("id", "r"), F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("r") / F.col("out")).alias("got"))
        loose = rank.filter("loose").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("held"))  # one row
        new = rank.select("id", "loose", F.col("r").alias("was")).join(sent, F.col("id") == F.col("dst"), "left").join(F.broadcast(loose))
        new = written(new.select("id", "loose", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("held") / n)).alias("r"), "was"), "rank")
        dropped(rank)
        rank = new
        if tolerance is not None and (rank.agg(F.sum(F.abs(F.col("r") - F.col("was")))).first()[0] or 0) < tolerance:
            break
    links.unpersist()
    dropped(base)
    return rank.select("id", F.round("r", 6).alias("pagerank"))


def hits(nodes: DataFrame, edges: DataFrame, steps: int = 5) -> DataFrame:
    """id, hub, authority after ``steps`` steps, each at length one. Edges are dealt out once by either end, and each half of a step is a table."""
    ids = written(nodes.select("id"), "nodes")
    links = {by: _held(edges.select("src", "dst"), by) for by in ("src", "dst")}

    def half(score: DataFrame, given: str, by: str, to: str, made: str) -> DataFrame:
        got = links[by].join(score, F.col(by) == F.col("id")).groupBy(to).agg(F.sum(given).alias("s"))
        raw = written(ids.join(got, F.col("id") == F.col(to), "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s")), "raw")
        size = raw.agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("size"))  # one row
        out = written(raw.join(F.broadcast(size)).select("id", F.when(F.col("size") > 0, F.col("s") / F.col("size")).otherwise(F.col("s")).alias(made)), made)
        dropped(raw)
        return out

    hub, auth = ids.select("id", F.lit(1.0).alias("h")), ids.select("id", F.lit(1.0).alias("a"))
    for step in range(steps):
        before = (hub, auth) if step else ()
        auth = half(hub, "h", "src", "dst", "a")
        hub = half(auth, "a", "dst", "src", "h")
        dropped(*before)
    for held in links.values():
        held.unpersist()
    return hub.join(auth, "id").select("id", F.round("h", 6).alias("hub"), F.round("a", 6).alias("authority"))


def export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as JSON lines: a row per node and edge, and one with their numbers; any size can be written."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("src", "dst")).alias("json"))
    meta = nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges.agg(F.count(F.lit(1)).alias("edges")))
    return n.union(e).union(meta.select(F.lit("meta").alias("kind"), F.to_json(F.struct("nodes", "edges")).alias("json")))


#: The pages of the trial graph, and its links as (page, relative href).
DEMO_PAGES = (("/intro", "Intro"), ("/pillar", "Pillar"), ("/posts/deep-dive", "Deep Dive"), ("/how-to", "How To"), ("/faq", "FAQ"), ("/resources", "Resources"))
DEMO_LINKS = ((0, "/pillar"), (1, "/posts/deep-dive"), (1, "/faq"), (2, "/resources"), (3, "/pillar"), (4, "/resources"))


def demo(spark: SparkSession, domain: str = "demo.local", site_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """A small graph for trials: items (id, site_id, url, title) and links (from_url, href), the hrefs relative."""
    items = spark.createDataFrame([(i + 1, site_id, f"https://{domain}{path}", title) for i, (path, title) in enumerate(DEMO_PAGES)], "id long, site_id long, url string, title string")
    return items, spark.createDataFrame([(f"https://{domain}{DEMO_PAGES[i][0]}", href) for i, href in DEMO_LINKS], "from_url string, href string")


def without_demo(items: DataFrame, site_id: int, hosts: tuple[str, ...] = ("example.com", "demo.local")) -> DataFrame:
    """Items without those of a site whose url holds one of ``hosts``."""
    of_demo = F.lit(False)
    for host in hosts:
        of_demo = of_demo | F.col("url").contains(host)
    return items.filter(~((F.col("site_id") == site_id) & F.coalesce(of_demo, F.lit(False))))
