import random

import pytest
from pyspark.sql import functions as F

from weftline.errors import BadRequest, NotFound
from weftline.functions import dates, text, urls, vectors
from weftline.operators import analytics, authority, cells, clustering, graph, retrieval, similarity, sites, store
from weftline.plans import tables
from weftline.sources import feeds, html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_freshness(spark):
    as_of = F.lit("2024-01-31").cast("date")
    score = lambda s: one(spark, dates.freshness(dates.parsed(F.lit(s)), as_of))
    assert score("2024-01-31") == 1 and abs(score("2024-01-01") - 0.5) < 1e-9
    assert [score(s) for s in ("2024-02-03", "", "no date", "2025/01/01", "2024", None)] == [0] * 6
    assert str(one(spark, dates.parsed(F.lit("2024-01-01T23:30:00-05:00")))) == "2024-01-02"


def test_keywords(spark):
    t = F.lit("Growth loops and growth SEO; GROWTH")
    assert [one(spark, text.keyword_count(t, F.lit(k))) for k in ("growth", "seo", "loops", "", None)] == [3, 1, 1, 0, 0]
    assert one(spark, text.contains_all(t, ["seo", " "])) and one(spark, text.contains_all(t, ["", None])) and not one(spark, text.contains_all(t, ["none"]))


def test_ngrams_bridge_stopwords_and_take_short_texts(spark):
    grams = lambda s: one(spark, text.ngrams(text.tokens(F.lit(s))))
    assert grams("Seo of growth") == ["seo", "growth", "seo growth"] and grams("Seo") == ["seo"] and grams("") == [] and grams(None) == []


def test_vectors(spark):
    assert one(spark, vectors.numbers(F.lit('{"data": [1, "x", 2.5]}'))) == [1.0, 2.5] and one(spark, vectors.numbers(F.lit("[]"))) is None
    assert one(spark, vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert abs(one(spark, vectors.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0)))) - 0.6) < 1e-9


def test_urls(spark):
    path = lambda u: one(spark, urls.path(F.lit(u)))
    assert [path(u) for u in ("https://a.example", "https://a.example/x//", "https://a.example/ y", None)] == ["/", "/x", "/", "/"]
    assert one(spark, urls.is_homepage(F.lit("https://a.example/"))) and not one(spark, urls.is_homepage(F.lit("https://a.example/?q=1")))
    assert not one(spark, urls.matches(F.lit("/x"), "(")) and one(spark, urls.matches(F.lit("/x"), "x"))
    # valid for one of Python and Java only
    assert not one(spark, urls.matches(F.lit("/x"), "(?P<a>x)")) and not one(spark, urls.matches(F.lit("/x"), r"\p{L}"))


def test_authority(spark):
    page = '<html><script type="application/ld+json">{"author":{"name":"Ann Lee"}}</script><meta name="author" content="ann lee"><p>By Bob Ray</p><a href="https://x.example/1">a</a><a href="http://y.example">b</a></html>'
    rows = spark.createDataFrame([("",), (page,), ("See [1] and https://z.example",)], "raw string")
    got = [tuple(r)[1:] for r in authority.signals(rows, "raw").collect()]
    assert got[0] == (0.0, 0, 0, 0, 0) and got[1][2:] == (2, 1, 2) and got[2][1] == 2


def test_entities_against_the_standard_library(spark):
    import re

    t = "The Quick Fox met Ann Lee and ann LEE. Ann Lee left. Old York Town Hall Gate."
    want = []
    for m in re.finditer(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b", t):
        if m[1].split()[0] not in authority.ENTITY_STOPS and m[1].lower() not in [w.lower() for w in want]:
            want.append(m[1])
    assert one(spark, authority.entities(F.lit(t))) == want


def test_links_keep_their_invariants(spark):
    rnd = random.Random(1)
    rows = [(i, f"https://a.example/{'x' if i % 5 else 'no'}/{i}" if i else "https://a.example/", [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    items = spark.createDataFrame(rows, "id long, url string, embedding array<double>")
    got = similarity.link_suggestions(items, 3, 0.2, "^/no/").collect()
    assert got and all(r["similarity"] >= 0.2 and r["source_id"] != r["target_id"] and r["target_id"] != 0 and "/no/" not in r["target_url"] + r["source_url"] for r in got)
    assert max(sum(r["source_id"] == s for r in got) for s in range(60)) <= 3
    assert similarity.link_suggestions(items.limit(0), 3).count() == 0


def pairs_of(df):
    return {(r["source_url"], r["target_url"]): r["similarity"] for r in df.collect()}


def test_links_by_cells_against_all_pairs(spark):
    rnd = random.Random(6)
    middles = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(15)]
    vectors_ = [[x + rnd.gauss(0, 0.5) for x in middles[i % 15]] for i in range(900)] + [[1.0] * 12] * 300  # a quarter are copies
    rows = [(i, f"https://a.example/{i % 1100}" if i else "https://a.example/", v) for i, v in enumerate(vectors_)]
    items = spark.createDataFrame(rows, "id long, url string, embedding array<double>").persist()
    exact = pairs_of(similarity.link_suggestions(items, 4, 0.3))
    found = pairs_of(cells.link_suggestions_indexed(items, 4, 0.3, cells=24, probes=6))
    assert sum(k in found for k in exact) >= 0.9 * len(exact) and max(found.values()) <= 1
    found = pairs_of(cells.link_suggestions_indexed(items, 4, 0.3, cells=40))  # as many probes as a sample needs
    assert sum(k in found for k in exact) >= 0.9 * len(exact)
    assert pairs_of(cells.link_suggestions_indexed(items, 4, 0.3, cells=5, probes=5)) == exact  # all cells are asked: nothing is missed
    for fallback in (False, True):
        some = items.filter("id % 7 = 0")
        assert pairs_of(cells.link_suggestions_indexed(some, 2, 0.8, "/1.$", fallback, cells=3, probes=3)) == pairs_of(similarity.link_suggestions(some, 2, 0.8, "/1.$", fallback))
    assert cells.link_suggestions_indexed(items.limit(0)).count() == 0


def test_cells_in_pieces_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(cells, "FOUND", 7)
    monkeypatch.setattr(cells, "ASKING", 11)
    rnd = random.Random(7)
    items = spark.createDataFrame([(i, f"https://a.example/{i}", [rnd.gauss(0, 1) for _ in range(5)]) for i in range(120)], "id long, url string, embedding array<double>")
    assert pairs_of(cells.link_suggestions_indexed(items, 3, 0.1, cells=2, probes=2)) == pairs_of(similarity.link_suggestions(items, 3, 0.1))


def test_kmeans_equals_a_plain_model(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(i % 3, 0.3), rnd.gauss(0, 0.3), rnd.gauss(-(i % 3), 0.3)]) for i in range(40)]
    unit = [[x / sum(y * y for y in v) ** 0.5 for x in v] for _, v in rows]
    centres, last = [unit[i] for i in random.Random(7).sample(range(40), 3)], None
    for _ in range(50):
        near = [min(range(3), key=lambda c: (sum((x - y) ** 2 for x, y in zip(v, centres[c], strict=True)), c)) for v in unit]
        if near == last:
            break
        last = near
        for c in range(3):
            own = [v for v, n in zip(unit, near, strict=True) if n == c]
            centres[c] = [sum(x) / len(own) for x in zip(*own, strict=True)] if own else centres[c]
    got = clustering.kmeans(spark.createDataFrame(rows, "id long, embedding array<double>"), 3, 7, dim=3)
    assert [r["cluster"] for r in got.orderBy("id").collect()] == near


ODD_VECTORS = [(1, "[1, 0, \"x\"]"), (1, '{"data": [0, 1]}'), (None, "[0, 1, 0.5, null]"), (4, "[]"), (5, None), (6, "oops"), (7, "[1e-3, 1]"), (8, "[0, 0]"), (9, "[1, 0.1]"), (9, "[1, 0.1]")]


def test_vectors_are_coerced_and_rows_are_their_own(spark):
    t = clustering.Vectors(spark.createDataFrame(ODD_VECTORS, "id long, embedding string"))
    rows = t.df.orderBy("row").collect()
    assert (t.n, t.dim) == (7, 3) and [r["row"] for r in rows] == list(range(7)) and [r["id"] for r in rows] == [1, 1, 7, 8, 9, 9, None]
    assert all(len(r["u"]) == 3 for r in rows) and rows[3]["u"] == [0, 0, 0] and abs(sum(x * x for x in rows[6]["u"]) - 1) < 1e-9
    nan = float("nan")
    arrays = spark.createDataFrame([(1, [1.0, None, 0.0]), (2, [nan, 1.0]), (3, [None, nan]), (4, [float("inf"), 2.0, 2.0])], "id long, embedding array<double>")
    assert [(r["id"], [round(x, 4) for x in r["u"]]) for r in clustering.Vectors(arrays).df.orderBy("row").collect()] == [(1, [1, 0]), (2, [1, 0]), (4, [0.7071, 0.7071])]
    assert clustering.Vectors(arrays.limit(0)).n == 0


def test_clusters_and_links_of_odd_vectors(spark):
    """Null components, mixed lengths, repeated and null ids."""
    rows = [(i % 10, [1.0, None, float(i % 2), 0.0] if i % 3 else [float(i % 2), 1.0]) for i in range(40)] + [(None, [0.0, 1.0])]
    items = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = clustering.kmeans(items, 3, seed=1).collect()
    assert len(got) == 41 and len({r["cluster"] for r in got}) == 3 and sum(r["id"] is None for r in got) == 1
    linked = items.withColumn("url", F.concat(F.lit("https://a.example/"), F.monotonically_increasing_id().cast("string"))).persist()
    links = similarity.link_suggestions(linked, 3, 0.1).collect()
    assert len(links) == 41 * 3 and all(0.1 <= r["similarity"] <= 1 and r["source_url"] != r["target_url"] for r in links)
    assert similarity.link_suggestions(spark.createDataFrame([(i, None if i == 2 else f"https://a.example/{i}", e) for i, e in ODD_VECTORS], "id long, url string, embedding string"), 2, 0.5).count() > 0


def test_restarts_spread_their_first_centres(spark):
    rnd = random.Random(3)
    middles = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    items = spark.createDataFrame([(i, [x + rnd.gauss(0, 0.02) for x in middles[i % 8]]) for i in range(400)], "id long, embedding array<double>")
    got = {r["id"]: r["cluster"] for r in clustering.kmeans_restarts(items, 8, seeds=(1, 2, 3)).collect()}
    assert len(got) == 400 and all(len({got[i] for i in range(m, 400, 8)}) == 1 for m in range(8)) and len(set(got.values())) == 8
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, embedding array<double>")
    assert {r["cluster"] for r in clustering.kmeans_restarts(same, 4, seeds=(1,)).collect()} == {0}


def test_sums_are_added_by_tasks_where_they_are_many(spark, monkeypatch):
    rnd = random.Random(4)
    items = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(200)], "id long, embedding array<double>").repartition(20)
    want = {r["id"]: r["cluster"] for r in clustering.kmeans(items, 5).collect()}
    monkeypatch.setattr(clustering, "SUMS_BYTES", 1)
    assert {r["id"]: r["cluster"] for r in clustering.kmeans(items, 5).collect()} == want


def test_labels_hold_no_substrings(spark):
    words = ["alpha beta", "alpha", "beta gamma", "gamma delta", "delta"]
    docs = spark.createDataFrame([(0, i, f"{words[i % 5]} {words[(i + 2) % 5]} other{i % 3}") for i in range(20)], "cluster_id int, id long, text string")
    got = clustering.labels(clustering.tfidf(docs), step=2).first()["labels"]
    assert got and not any(a != b and a in b for a in got for b in got)


def test_labels_in_steps_are_those_of_one(spark):
    rnd = random.Random(8)
    pool = ["al", "alpha", "alphabet", "be", "beta", "betas", "ga", "gamma", "de", "delta", "ep", "eps"]
    docs = spark.createDataFrame([(i % 3, i, " ".join(rnd.choices(pool, k=12))) for i in range(60)], "cluster_id int, id long, text string")
    told = lambda step: {r["cluster_id"]: r["labels"] for r in clustering.labels(clustering.tfidf(docs, max_ratio=1.0), step=step).collect()}
    assert told(1) == told(3) == told(1000) and all(len(x) == 6 for x in told(1000).values()) and set(told(1)) == {0, 1, 2}
    assert clustering.labels(clustering.tfidf(docs.limit(0))).count() == 0


def test_steps_over_a_graph_move_no_edges(spark):
    nodes = spark.range(50)
    edges = spark.range(400).select((F.col("id") % 50).alias("src"), (F.col("id") * 7 % 43).alias("dst")).distinct()
    held = graph._held(edges, "src")
    step = held.join(nodes.withColumn("r", F.lit(1.0)), F.col("src") == F.col("id")).hint("merge").groupBy("dst").agg(F.sum("r"))
    plan = step._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("InMemoryTableScan")
    assert "Exchange" not in plan[plan.rindex("Join", 0, scan) : scan]
    far = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, edges, 60).collect()}
    near = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, edges, 60, tolerance=1e-7).collect()}
    assert max(abs(far[i] - near[i]) for i in far) <= 2e-6


def test_graph_fixture(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (2, 4), (5, 1), (3, 4)], "src long, dst long")
    rank = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, edges).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-4 and max(rank, key=rank.get) == 4
    assert {r["id"]: (r["degree_in"], r["degree_out"]) for r in graph.degrees(nodes, edges).collect()}[1] == (2, 2)


def test_html_and_feeds(spark, tmp_path):
    page = "<html><head><title>T</title><meta name='date' content='on 2024-02-03'></head><body><nav><p>menu</p></nav><article><p>one<p>two <b>x</p><script>'</p>'</script></article></body></html>"
    df = spark.createDataFrame([("https://a.example/p", page), (None, None)], "url string, html string")
    got = df.select(html.extract("html").alias("x"), html.publish_date("html").alias("d")).collect()
    assert got[0]["x"]["title"] == "T" and got[0]["x"]["content"] == "one two x" and got[0]["d"] == "2024-02-03T00:00:00" and got[1]["x"]["content"] == ""
    maps = spark.createDataFrame([("i", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc>p</loc></url></urlset>"), ("bad", "<x")], "url string, xml string")
    assert [r["page_url"] for r in feeds.walk_sitemaps(maps, "i").collect()] == ["p"] and feeds.page_urls(maps, "bad").count() == 0
    store = tmp_path / "brands.json"
    assert feeds.read_brands(spark, str(tmp_path / "none.json")).count() == 0
    for body, n in (('{"brands":[{"key":"a","name":"A"}]}', 1), ('[{"key":"b"}]', 1), ("", 0), ("{broken", 0)):
        store.write_text(body)
        assert feeds.read_brands(spark, str(store)).count() == n


LD = '<script type="application/ld+json">%s</script>'


@pytest.mark.parametrize(("page", "want"), [
    (LD % '{"author":{"name":" Ann Lee "}}', ["Ann Lee"]),
    (LD % '{"author":[{"name":"Ann Lee"}]}', ["Ann Lee"]),
    (LD % '{"author":[{"name":"Ann Lee"},{"name":"Bo Ek"},{"name":7},{"x":1},"Cy",{"name":"ANN LEE"}]}', ["Ann Lee", "Bo Ek"]),
    (LD % '[{"author":{"name":"Ann Lee"}},3,{"author":[{"name":"Bo Ek"}]}]', ["Ann Lee", "Bo Ek"]),
    (LD % '{"author":"Ann Lee"}' + LD % "{broken" + LD % '{"author":{"name":"Bo Ek"}}', ["Bo Ek"]),
    ('<meta content="Ann" name="author"><meta name=author content=Bo><META CONTENT=\'Cy\' PROPERTY=\'article:author\'><meta name="twitter:creator" content="@dd>d"><meta name="other" content="no">', ["Ann", "Bo", "@dd>d", "Cy"]),
    ("<p>By Ann Lee. by nobody</p>", ["Ann Lee."]),
    ("", []),
])
def test_bylines(spark, page, want):
    assert one(spark, authority.bylines(authority.html_text(F.lit(page)), F.lit(page))) == want


def test_json_ld_is_there_or_not(spark):
    rows = spark.createDataFrame([(1, LD % "{}</p>"[:2]), (2, LD % ""), (3, LD % "{broken"), (4, "<p>x</p><a class='y' href=' https://b.example/z'>z</a>")], "id long, raw string")
    got = {r["id"]: (r["schema_present"], r["external_links"]) for r in authority.signals(rows, "raw").collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (0, 0), 4: (0, 1)}


@pytest.mark.parametrize(("page", "want"), [
    ("<header><p>lead</p></header><p>body</p><footer><p>foot</p></footer>", "lead body foot"),
    ("<nav><p>one<p>two</nav><article><p>three <aside>four</aside> five</p></article><aside>six</aside>", "one two three four five"),
    ("<script>'<p>no</p>'</script><style><p>no</p></style><template><p>no</p></template><noscript><p>yes</p></noscript><p>x<script>no</script>y", "yes x y"),
])
def test_competitors_paragraphs(spark, page, want):
    got = spark.createDataFrame([(page,)], "html string").select(html.extract_competitor("html").alias("x")).first()["x"]
    assert got["content"] == want and got["word_count"] == len(want.split())


def test_long_repeats_end(spark):
    words = F.lit("a-" * 1_000_000 + "a")
    assert one(spark, text.tokens(words)) == ["a-" * 1_000_000 + "a"]
    names = spark.createDataFrame([("By " + "Aa Bb " * 300_000,)], "raw string")
    assert authority.signals(names, "raw").first()["bylines"] == 1


def test_resolving_a_site(spark):
    rows = spark.createDataFrame([(1, "a.example"), (2, "b.example")], "id long, domain string")
    assert sites.resolve(rows, domain="b.example") == 2 and sites.resolve(rows, 1, "b.example") == 1
    for error, args in ((BadRequest, {}), (NotFound, {"site_id": 9}), (NotFound, {"domain": "c.example"})):
        with pytest.raises(error):
            sites.resolve(rows, **args)


def test_purge_says_what_a_dry_run_would_delete(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", None)], "id long, domain string, post boolean")
    left, told = sites.purge(rows, F.col("post"))
    assert left.count() == 3 and {tuple(r) for r in told.collect()} == {("a", 1, 0), ("b", 0, 0)}
    left, told = sites.purge(rows, F.col("post"), dry_run=False)
    assert {r["id"] for r in left.collect()} == {1, 3} and {tuple(r) for r in told.collect()} == {("a", 1, 1), ("b", 0, 0)}


def test_serialised_items(spark):
    row = sites.serialised(spark.createDataFrame([(1, "u", "t", None)], "id long, url string, title string, schema_types array<string>")).first()
    assert row["schema_types"] == [] and row["lastmod"] is None and row["word_count"] is None


def test_sitemaps_are_walked_in_order(spark):
    """Level by level, in the order of names; cycles, repeats and malformed files end or are left out."""
    urlset = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    rows = [("i", index("z", "a", "i", "bad", "gone")), ("z", urlset("p9", "deep.xml", "p1")), ("a", urlset("p1", "p0")), ("deep.xml", index("a", "last")), ("last", urlset("p5")), ("bad", "<urlset><url>"), ("j", urlset("only"))]
    maps = spark.createDataFrame(rows, "url string, xml string")
    entries = spark.createDataFrame([("s", "i"), ("t", "j"), ("u", "none"), ("v", "a")], "site string, url string")
    got = [(r["site"], r["place"], r["page_url"]) for r in feeds.walk_sitemaps(maps, entries).orderBy("site", "place").collect()]
    assert got == [("s", 1, "p9"), ("s", 2, "p1"), ("s", 3, "p0"), ("s", 4, "p5"), ("t", 1, "only"), ("v", 1, "p1"), ("v", 2, "p0")]
    assert {r["page_url"] for r in feeds.walk_sitemaps(maps, "i", 3).collect()} == {"p9", "p1", "p0"}


def test_brands(spark, tmp_path):
    path = str(tmp_path / "brands")
    none = feeds.read_brands(spark, path)
    feeds.write_brands(feeds.with_brand(feeds.with_brand(none, key="a", name="A", categories=["x"]), key="b", name="B"), path)
    have = feeds.read_brands(spark, path)
    assert {(r["key"], r["name"]) for r in have.collect()} == {("a", "A"), ("b", "B")}
    feeds.write_brands(feeds.updated_brand(feeds.with_brand(have, key="a", audience="all"), "b", name=None, site_url="https://b.example"), path)
    rows = {r["key"]: r for r in feeds.read_brands(spark, path).collect()}
    assert rows["a"]["name"] == "A" and rows["a"]["audience"] == "all" and rows["a"]["categories"] == ["x"] and rows["b"]["name"] == "B" and rows["b"]["site_url"] == "https://b.example"
    feeds.write_brands(feeds.without_brand(feeds.read_brands(spark, path), "a"), path)
    left = feeds.read_brands(spark, path)
    assert [r["key"] for r in left.collect()] == ["b"]
    for error, call in ((BadRequest, lambda: feeds.with_brand(left, name="x")), (BadRequest, lambda: feeds.with_brand(left, key="a b")), (NotFound, lambda: feeds.updated_brand(left, "z", name="Z")), (NotFound, lambda: feeds.without_brand(left, "z"))):
        with pytest.raises(error):
            call()
    assert [r["key"] for r in feeds.brand_list(left, category="X").collect()] == []


@pytest.mark.parametrize("step", ["save", "_point", "_swap", "_clean"])
def test_a_write_that_fails_leaves_the_old_or_the_new_rows(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "store")
    read = lambda: sorted(r["id"] for r in spark.read.parquet(tables.current(spark, path)).collect())
    assert tables.current(spark, path) is None
    tables.replaced(spark.range(3), path)
    tables.replaced(spark.read.parquet(tables.current(spark, path)).filter("id > 0"), path)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        rows = spark.range(9)
        if step == "save":
            rows = rows.select(F.when(F.col("id") == 8, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
        else:
            m.setattr(tables, step, fails)
        with pytest.raises(Exception, match="lost"):
            tables.replaced(rows, path)
    assert read() == (list(range(9)) if step == "_clean" else [1, 2])
    before = tables.current(spark, path)
    tables.replaced(spark.range(4), path)
    assert read() == [0, 1, 2, 3]
    left = {x.name for x in (tmp_path / "store").iterdir() if not x.name.endswith(".crc")}
    assert left == {"current", before.rsplit("/", 1)[1], tables.current(spark, path).rsplit("/", 1)[1]}


def test_snapshots_are_ingested_once(spark):
    have = analytics.stub_snapshot(spark, 1, "gsc", "2024-01-15").select("site_id", "source", "captured_at", "clicks")
    new = analytics.stub_snapshot(spark, 1, "ga4", "2024-01-15", notes={"by": "me"})
    rows = analytics.ingested(analytics.ingested(have, new), new.unionByName(have, allowMissingColumns=True)).collect()
    assert {(r["source"], r["clicks"], r["organic_sessions"], r["revenue"]) for r in rows} == {("gsc", 123, None, None), ("ga4", None, 789, 1234.56)} and len(rows) == 2
    ga4 = next(r for r in rows if r["source"] == "ga4")
    assert str(ga4["period_start"]) == "2024-01-08 00:00:00" and ga4["notes"] == {"by": "me"}
    with pytest.raises(BadRequest):
        analytics.stub_snapshot(spark, 1, "other", "2024-01-15")
    both = spark.range(1).select(analytics.merged_notes(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"), analytics.merged_notes(F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>")).alias("n")).first()
    assert both["m"] == {"a": "1", "b": "3"} and both["n"] == {}


def test_reembedding_scopes(spark):
    rows = spark.createDataFrame([(1, "d", "u1", "t", None), (2, "d", "u2", None, []), (3, "e", "u3", "t", [1.0])], "id long, domain string, url string, title string, embedding array<double>")
    done = lambda **k: {r["id"] for r in store.reembedded(rows, **k).filter("updated and size(embedding) = 64").collect()}
    assert done() == {1, 2} and done(scope="all") == {1, 2, 3} and done(scope="single", url="u3") == {3} and done(scope="all", domain="e") == {3}
    assert [r["embedding"] for r in store.reembedded(rows).filter("id = 3").collect()] == [[1.0]]
    for bad in ({"scope": "some"}, {"scope": "single"}):
        with pytest.raises(BadRequest):
            store.reembedded(rows, **bad)


def test_retrieval_index(spark):
    docs = spark.createDataFrame([("doc-1", "https://ex.com/1", "Doc 1", "apples and oranges"), ("doc-2", "https://ex.com/2", "Doc 2", "bananas are yellow"), ("doc-3", "https://ex.com/3", "Doc 3", "grapes grow in clusters")], "id string, url string, title string, text string")
    index = store.retrieval_upserted(store.retrieval_upserted(None, docs), docs.limit(1).withColumn("text", F.lit("yellow fruit")))
    assert index.count() == 3
    found = similarity.retrieve(index, "yellow fruit", 2).collect()
    assert len(found) == 2 and found[0]["id"] == "doc-1" and found[0]["score"] == 1.0
    assert similarity.retrieve(index, "fruit", 1).count() == 1 and similarity.retrieve(index, "fruit", 5, filters={"site_id": 999999}).count() == 0


def grouped_texts(spark, groups=24, each=40):
    """Texts in groups: a text of its own for each, of which every member has three characters changed; one group has copies of one text."""
    draw, rows = random.Random(5), []
    for g in range(groups):
        base = [draw.choice("abcdefghij klmnop") for _ in range(400)]
        for i in range(each):
            own = list(base)
            for at in draw.sample(range(400), 0 if g == 3 else 3):
                own[at] = draw.choice("xyz")
            rows.append((g * each + i, f"https://s{g % 2}.example/{g}/{i}", f"t{i}", "".join(own), g))
    return spark.createDataFrame(rows, "id long, url string, title string, text string, topic long"), rows


def same_rows(found, exact):
    key = lambda df: [(r["id"], r["score"]) for r in df.select("id", "score").collect()]
    return key(found) == key(exact)


def test_stored_index_finds_what_a_scan_finds_and_opens_few_cells(spark, tmp_path):
    docs, rows = grouped_texts(spark)
    path = str(tmp_path / "index")
    with pytest.raises(NotFound):
        retrieval.search(spark, path, "x")
    retrieval.build(docs, path, n_cells=24)
    near = 0
    for g in (0, 3, 9, 17):
        asked = rows[g * 40 + 7][3]
        exact = similarity.retrieve(docs, asked, 10)
        found = retrieval.search(spark, path, asked, 10)
        assert same_rows(found, exact) and set(found.columns) == {*docs.columns, "score"}
        cut = retrieval.search(spark, path, asked, 10, probes=3, exact=False)
        near += len({r["id"] for r in cut.collect()} & {r["id"] for r in exact.collect()})
    assert near >= 36  # 0.9 of 40
    for more in ({"site": "//s1."}, {"filters": {"topic": 4}}, {"site": "//s0.", "filters": {"topic": 5}}, {"filters": {"none": 1}}):
        assert same_rows(retrieval.search(spark, path, rows[200][3], 7, **more), similarity.retrieve(docs, rows[200][3], 7, **more))
    for asked, k in (("", 3), ("q", 2000), (rows[5][3], 0)):
        assert same_rows(retrieval.search(spark, path, asked, k), similarity.retrieve(docs, asked, k))


def test_exact_search_reads_only_cells_that_can_hold_better_rows(spark, tmp_path):
    docs, rows = grouped_texts(spark)
    path = str(tmp_path / "index")
    retrieval.build(docs, path, n_cells=24)
    _, listed = retrieval._opened(spark, path)
    assert listed["cell_rows"].sum() == len(rows) and len(listed) > 10
    for g in (1, 9, 20):
        assert len(retrieval.cells_for(spark, path, rows[g * 40][3], 10, probes=2)) < len(listed) / 2
    assert len(retrieval.cells_for(spark, path, "q", 2000)) == len(listed)  # more than there are: all
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        plan = retrieval.search(spark, path, rows[9 * 40][3], 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "cell#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]


def test_stored_index_takes_rows_in_and_survives_nulls(spark, tmp_path):
    docs, rows = grouped_texts(spark, 6, 20)
    path = str(tmp_path / "index")
    retrieval.upserted(docs, path)
    new = spark.createDataFrame([(3, "u3", "n", "quite another text", 9), (900, "u900", None, None, 9), (None, "u", None, "no id", None), (901, None, None, "", 9)], "id long, url string, title string, text string, topic long")
    for _ in range(2):  # again is no change
        retrieval.upserted(new, path)
        whole = docs.filter("id <> 3").unionByName(new)
        for asked in ("quite another text", "no id", rows[50][3]):
            assert same_rows(retrieval.search(spark, path, asked, 8), similarity.retrieve(whole, asked, 8))
        assert retrieval.search(spark, path, "a", 999).count() == whole.count()
    retrieval.build(docs.limit(0), path)
    assert retrieval.search(spark, path, "a").count() == 0
    retrieval.upserted(docs.withColumn("cell", F.lit("own")).withColumn("embedding", F.lit("own")), path)
    assert retrieval.search(spark, path, "a", 999).count() == docs.count()


def test_fetched_files(spark, tmp_path):
    import gzip

    packed = gzip.compress("<p>é</p>".encode() * 50)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, body in (("a.html.gz", packed), ("deep/b.html", b"plain"), ("c.gz", packed[: len(packed) // 2]), ("d.gz", b"not packed"), ("e.bin", gzip.compress(b"x") + gzip.compress(b"y")), ("f", b""), ("g", b"x" * 2000), ("h.gz", gzip.compress(b"x" * 2000))):
        (tmp_path / "in" / name).write_bytes(body)
    got = {r["url"].rsplit("/", 1)[1]: r for r in feeds.fetched(spark, str(tmp_path / "in"), most=1000).collect()}
    assert set(got) == {"a.html.gz", "b.html", "c.gz", "d.gz", "e.bin"}  # f is empty, g is too long, h once unpacked
    assert got["a.html.gz"]["html"] == "<p>é</p>" * 50 and got["a.html.gz"]["packed"] and got["a.html.gz"]["length"] == len(packed)
    assert got["b.html"]["html"] == "plain" and got["e.bin"]["html"] == "xy" and got["d.gz"]["html"] == "not packed"
    assert "\ufffd" in got["c.gz"]["html"] and got["c.gz"]["packed"]
    assert {r["url"].rsplit("/", 1)[1] for r in feeds.fetched(spark, str(tmp_path / "in"), files="*.html").collect()} == {"b.html"}


def test_embedders():
    assert [vectors.embedder(*a)[1] for a in (("hash64",), ("hash",), ("hash32",), ("hash32", "16"), ("hash32", "x"), ("other9",), ("char8", 0))] == [64, 64, 32, 16, 64, 64, 1]


def test_char_hash_equals_its_formula(spark):
    def plain(t, dim):
        acc = [0] * dim
        for i, c in enumerate(t):
            h = (ord(c) * 1315423911 + i * 2654435761) & 0xFFFFFFFF
            acc[h % dim] += ((h >> 24) & 0xFF) - 128
        n = sum(x * x for x in acc) ** 0.5 or 1
        return [x / n for x in acc]

    texts = ["probe", "", None, "é𝒳 longer text " * 50]
    got = [r["e"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(vectors.char_hash(F.col("t"), 16).alias("e")).collect()]
    assert all(abs(x - y) < 1e-6 for e, t in zip(got, texts, strict=True) for x, y in zip(e, plain(t or "", 16), strict=True))


def test_vectors_of_any_length_count_whole(spark):
    rows = [(i, [1.0] * 126 + ([5.0, 0.0] if i % 2 else [0.0, 5.0]), i % 2) for i in range(10)] + [(10, [1.0] * 126, 0)]
    items = spark.createDataFrame(rows, "id long, embedding array<double>, cluster_id int")
    assert clustering.centroids(items).first()["centroid"].__len__() == 128 and clustering.dimensions(items) == 128
    got = {r["id"]: r["cluster"] for r in clustering.kmeans(items, 2, seed=1).collect()}
    assert len({got[i] for i in range(0, 10, 2)}) == 1 and got[0] != got[1]
    assert min(r["similarity"] for r in clustering.members(items.filter("id < 10")).collect()) > 0.99
    again = {r["id"]: r["cluster"] for r in clustering.kmeans_restarts(items, 2, seeds=(1, 2, 3)).collect()}
    assert again[0] != again[1] and clustering.kmeans_restarts(items.limit(0), 2).count() == 0


def test_cluster_sizes_hold_empty_ones(spark):
    rows = spark.createDataFrame([(0,), (2,), (2,), (None,)], "cluster_id int")
    assert [tuple(r) for r in clustering.sizes(rows).collect()] == [(2, 2), (0, 1), (1, 0)] and clustering.sizes(rows.limit(0)).count() == 0


def test_demo_graph(spark):
    items, links = graph.demo(spark)
    assert {tuple(r) for r in graph.link_edges(links, items).collect()} == {(1, 2), (2, 3), (2, 5), (3, 6), (4, 2), (5, 6)}
    assert graph.without_demo(items, 1).count() == 0 and graph.without_demo(items, 2).count() == 6


def test_sitemaps_are_walked_to_the_end(spark):
    deep = [(f"m{i}", f"<sitemapindex><sitemap><loc>m{i + 1}</loc></sitemap></sitemapindex>") for i in range(20)] + [("m20", "<urlset><url><loc>last</loc></url></urlset>")]
    assert [r["page_url"] for r in feeds.walk_sitemaps(spark.createDataFrame(deep, "url string, xml string"), "m0").collect()] == ["last"]


def test_sinks(spark, tmp_path):
    import datetime as dt
    import json

    rows = spark.createDataFrame([(1, "Item, 1", None)], "id long, title string, note string")
    path = feeds.export_csv(rows, str(tmp_path), "a/b", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("export_a-b_20240102_030405.csv") and spark.read.option("header", True).csv(path).first()["title"] == "Item, 1"
    feeds.export_jsonl(rows, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"id": 1, "title": "Item, 1", "note": None}


def test_fetched_bytes(spark):
    import gzip

    rows = [("https://a/x.xml.gz", None, gzip.compress("é".encode())), ("https://a/x.xml.gz", None, b"plain"), ("u", "application/x-gzip", gzip.compress(b"z")), ("u", None, b"\xff"), ("u", None, None)]
    df = spark.createDataFrame(rows, "url string, kind string, body binary")
    assert [r[0] for r in df.select(feeds.decoded(F.col("url"), F.col("kind"), F.col("body"))).collect()] == ["é", "plain", "z", "\ufffd", None]
    ok = spark.createDataFrame([("text/HTML", 10, 200), ("text/plain", 10, 200), ("text/html", 3_000_000, 200), ("text/html", 10, 404), (None, 10, 200), ("text/html", None, None)], "t string, n int, s int")
    assert [r[0] for r in ok.select(feeds.acceptable(F.col("t"), F.col("n"), F.col("s"))).collect()] == [True, False, False, False, False, True]


def test_external_links_without_the_own_host(spark):
    page = F.lit('<a href="https://A.example/1">x</a><a class="c" href=\'http://b.example\'>y</a><a href="/r">z</a>')
    assert one(spark, authority.external_links(page))["count"] == 2 and one(spark, authority.external_links(page, F.lit("https://a.example/")))["domains"] == ["b.example"]


def test_partial_updates_keep_what_is_not_given(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, name string, note string")
    s = spark.createDataFrame([(1, None, "y"), (3, "c", None)], "id long, name string, note string")
    assert {tuple(r) for r in store.patched(t, s, "id").collect()} == {(1, "a", "y"), (2, "b", None), (3, "c", None)}
    assert {tuple(r) for r in store.patched(t, s.select("id", "name"), "id", insert=False).collect()} == {(1, "a", "x"), (2, "b", None)}


def test_corpus_terms_against_a_plain_model(spark):
    import math
    from collections import Counter

    rnd = random.Random(5)
    docs = [(i % 3, i, " ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "é2", "x"], k=rnd.randrange(1, 9)))) for i in range(30)]
    words = {i: Counter(w for w in t.split() if len(w) > 1) for _, i, t in docs}
    df = Counter(w for c in words.values() for w in c)
    sums = Counter()
    for c, i, _ in docs:
        w = {t: n * (math.log((1 + 30) / (1 + df[t])) + 1) for t, n in words[i].items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            sums[c, t] += x / size / 10
    want = {(c, n + 1, t) for c in range(3) for n, (t, _) in enumerate(sorted(((t, s) for (k, t), s in sums.items() if k == c), key=lambda x: (-round(x[1], 6), x[0]))[:3])}
    got = clustering.corpus_terms(spark.createDataFrame(docs, "cluster_id int, id long, text string"), 3).collect()
    assert {(r["cluster_id"], r["place"], r["term"]) for r in got} == want and all(abs(r["score"] - sums[r["cluster_id"], r["term"]]) < 1e-5 for r in got)


def test_stream(spark, tmp_path):
    from weftline.streaming.latest import latest, latest_stream

    rows = spark.createDataFrame([(1, 1, "view", "2024-01-01 00:00:00", 1.0), (2, 1, "view", "2024-01-02 00:00:00", 2.0)], "id long, site_id long, source string, captured_at string, revenue double").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    latest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    spark.createDataFrame([(3, 1, "view", "2024-01-01 12:00:00", 3.0), (4, 2, "view", "2024-01-01 12:00:00", 3.0)], "id long, site_id long, source string, captured_at string, revenue double").withColumn("captured_at", F.col("captured_at").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    latest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r["id"] for r in latest(spark, str(tmp_path / "out")).collect()} == {2, 4}
