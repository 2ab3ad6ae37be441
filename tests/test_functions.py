"""URL keys, structured data, extraction, clustering, graph, ad-hoc queries and streams against plain versions."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlspan.functions import jsonld, urls
from crawlspan.operators import adhoc, crawl, demand, graph, recon, research, structured
from crawlspan.plans.registry import ready
from crawlspan.sources import sinks
from crawlspan.streaming import facts

URLS = ["http://www.A.example:80/x/?utm_source=a&b=2&a=1#f", "https://a.example", "https://a.example/", "https://a.example/x//", "mailto:x@y", "HTTPS://A.example/p?ref=1", "https://a.example:8443/x?q=a+b", "https://a.example/a b", "not a url", "https://a.example/x?a=1&a=0&b", " https://a.example/t/ ", "https://u:p@a.example/x?GCLID=1&_hsenc=2&z=%C3%A9"]


def test_url_key_twin(spark):
    for form in ("asis", "apex", "www"):
        df = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", urls.url_key(F.col("url"), form).alias("k")).collect()
        assert {r.url: r.k for r in df} == {u: urls.url_key_py(u, form) for u in URLS}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "utm_x", "ref"]), max_size=4), st.text("abc/", max_size=6))
def test_url_key_idempotent(names, path):
    url = f"http://www.h.example/{path.rstrip('/')}?" + "&".join(f"{n}={i}" for i, n in enumerate(names))
    assert urls.url_key_py(urls.url_key_py(url, "apex"), "apex") == urls.url_key_py(url, "apex")


def test_morphology(spark):
    cases = {"https://a.example/shop/42": "/shop/[NUM]", "https://a.example/blog/my-post.html?b=1&A=2": "/blog/[SLUG].html?a&b", "https://a.example/2024/05/x": "/[NUM]/[NUM]/x", "https://a.example/about": "/about"}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.morphology(F.col("u")).alias("m")).collect()
    assert {r.u: r.m for r in got} == cases


def kinds(*blocks):
    return sorted((i["kind"], i["type"]) for i in jsonld.validate(list(blocks)))


CTX = '{"@context":"https://schema.org",'


@pytest.mark.parametrize(
    ("block", "want"),
    [
        (CTX + '"@type":"Article","headline":"h","author":"a","datePublished":"2024-01-02","image":"https://x/y.png"}', []),
        (CTX + '"@type":"Article","headline":"h"}', [("required", "Article")]),
        (CTX + '"@type":"Product","name":"n","offers":{"priceCurrency":"USD"}}', [("required", "Product")]),
        ('{"@type":"WebSite","url":"https://x"}', [("context", "WebSite")]),
        ("{bad,}", [("parse", None)]),
        (CTX + '"name":"n"}', [("type", None)]),
        (CTX + '"@type":"Recipe","name":"n","image":"/rel.png"}', [("value", "Recipe")]),
        (CTX + '"@type":"Product","name":"n","offers":{"price":"$10","priceCurrency":"usd"}}', [("value", "Product"), ("value", "Product")]),
        (CTX + '"@type":"HowTo"}', [("forbidden", "HowTo")]),
        (CTX + '"@type":"JobPosting","title":"t","description":"d","datePosted":"2024-01-01","hiringOrganization":"o","jobLocationType":"x"}', []),
        (CTX + '"@type":"AggregateRating","ratingValue":7}', [("value", "AggregateRating")]),
        (CTX + '"@graph":[{"@type":"Dataset","name":"n","description":"d"},{"@type":"Dataset","name":"n"}]}', []),
    ],
)
def test_validator(block, want):
    assert kinds(block) == want


def test_extract():
    html = """<html lang=en><head><title> A  page</title><link rel=canonical href="/x"><link rel="canonical" href="https://h.example/y"><link rel=icon href=i><meta name=robots content="NOINDEX"><meta property="og:title" content=o>
    <script type="application/ld+json">{"a":1}</script><script src="http://cdn.example/a.js"></script></head><body><nav><a href="/n">nav</a></nav><h1>Top</h1><h3>Skip</h3><p>some words of text that are long enough<img src=a.png><img src=b alt=""><img alt=x width=1>
    <a href="https://www.h.example/in">in <b>side</b></a><a href="https://o.example/">out</a><a href="mailto:a@b">m</a><a href="/cdn-cgi/l">c</a></p><footer><a href="/f">foot</a></footer></body></html>"""
    r = crawl.read(html, "https://h.example/page")
    assert (r["title"], r["h1"], r["h1_count"], r["heading_skips"], r["lang"], r["noindex"]) == ("A page", "Top", 1, 1, "en", True)
    assert (r["canonical_count"], r["canonical_relative"], r["canonical_url"]) == (2, True, "https://h.example/x")
    assert (r["image_count"], r["images_without_alt"], r["images_missing_dimensions"]) == (3, 1, 2)
    assert [(x["target"], x["internal"], x["placement"]) for x in r["links"]] == [("https://h.example/n", True, "navigation"), ("https://www.h.example/in", True, "body"), ("https://o.example/", False, "body"), ("https://h.example/f", True, "footer")]
    assert (r["mixed_content_count"], r["json_ld"], r["has_favicon"], r["og_tags"]) == (1, ['{"a":1}'], True, {"og:title": "o"})
    assert r["body_chunks"][0]["heading"] == "Top" and "enough" in r["body_chunks"][1]["text"]
    assert crawl.read(None, None)["word_count"] == 0


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: mybot\nUser-agent: other\nDisallow: /a\nAllow: /a/b # ok\nDisallow:\n"
    assert crawl.robots_rules(text, "MyBot/1") == [("/a", False), ("/a/b", True)]
    rules = spark.createDataFrame(crawl.robots_rules(text, "mybot"), "path string, allow boolean")
    u = spark.createDataFrame([("/",), ("/a/x",), ("/a/b/c",)], "path string")
    assert {r.path: r.allowed for r in crawl.allowed(u, rules).collect()} == {"/": True, "/a/x": False, "/a/b/c": True}


def test_greedy():
    f = lambda s: (s, frozenset(s.split()))
    assert demand.greedy([f("a b"), f("a b c"), f("x y"), f("c a")], 0.5) == [0, 0, 1, 0]
    assert demand.greedy([], 0.5) == []


def test_blocks_keep_clusters(spark):
    """Clustering by connected vocabulary gives what clustering everything at once gives."""
    qs = ["blue chair", "blue chair oak", "red lamp", "lamp red led", "green", "oak table", "table top"]
    df = spark.createDataFrame([(q, 100 - i) for i, q in enumerate(qs)], "query string, w int").withColumn("toks", demand.tokens(F.col("query")))
    got = {r["query"]: r["head"] for r in demand.cluster(df, "query", "toks", "w", 0.5).collect()}
    n = demand.greedy([(q, frozenset(q.split())) for q in qs], 0.5)
    first = {}
    for q, i in zip(qs, n, strict=True):
        first.setdefault(i, q)
    assert got == {q: first[i] for q, i in zip(qs, n, strict=True)}


def plain_ipr(nodes, edges, rounds=30):
    n = len(nodes)
    pr = dict.fromkeys(nodes, 1 / n)
    out = dict.fromkeys(nodes, 0.0)
    for s, _, w in edges:
        out[s] += w
    for _ in range(rounds):
        loose = sum(pr[x] for x in nodes if not out[x])
        nxt = {x: 0.15 / n + 0.85 * loose / n for x in nodes}
        for s, t, w in edges:
            nxt[t] += 0.85 * pr[s] * w / out[s]
        pr = nxt
    return pr


def test_graph(spark):
    nodes = list("abcde")
    links = [("a", "b", "body"), ("a", "b", "body"), ("a", "c", "footer"), ("b", "c", "body"), ("c", "a", "navigation"), ("d", "a", "body"), ("a", "a", "body"), ("a", "z", "body")]
    p = spark.createDataFrame([(x, i, 0) for i, x in enumerate(nodes)], "url_key string, depth int, inlink_count int")
    e = spark.createDataFrame([(s, t, pl, True) for s, t, pl in links], "source_key string, target_key string, placement string, is_internal boolean")
    want = plain_ipr(nodes, [(s, t, 1.0 if pl == "body" else 0.2) for s, t, pl in links if s != t and t != "z"])
    got = {r.url_key: r["rank"] for r in graph.ipr(p, e, close=0).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert {r.url_key: r.inlink_count for r in graph.indegree(p, e).collect()} == {"a": 2, "b": 2, "c": 2, "d": 0, "e": 0}
    assert {r.url_key: r.click_depth for r in graph.click_depth(p, e, "a").collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}
    assert {r.url_key: r.click_depth for r in graph.click_depth(p, e, "nowhere").collect()}["a"] == 0


def test_payload_holds_every_dataset(spark, data):
    import json

    from crawlspan.operators.datasets import DATASETS, payload
    from crawlspan.plans.dialect import SPARK

    s = ready(spark, data)
    got = {}
    for r in payload(s).collect():
        got.setdefault(r.dataset, []).append(json.loads(r.body))
    for name in ("summary", "top_keywords", "crawl_health", "link_flows"):
        want = [json.loads(x) for x in s.sql(DATASETS[name](SPARK)).toJSON().collect()]
        assert sorted(map(str, got[name])) == sorted(map(str, want)), name
    assert len(got) > 15


def test_adhoc_rejects(spark, data):
    s = ready(spark, data)
    for bad in (dict(table="secrets"), dict(table="sa", group_by=("nope",)), dict(table="sa", metrics=(("sum", "query"),)), dict(table="sa", limit=501), dict(table="sa", filters=(("clicks", "drop", 1),)), dict(table="sa", group_by=("device",), order_by="x; DROP")):
        with pytest.raises(adhoc.BadQuery):
            adhoc.query_data(s, **bad)
    assert adhoc.query_data(s, "sa", "rows", offset=5, limit=3).count() == 3


def test_merge_and_streams(spark, tmp_path):
    d = dt.date(2024, 1, 1)
    cols = "date date, query string, page_key string, device string, country string, clicks int"
    old = spark.createDataFrame([(d, "q", "p", "", None, 1), (d, "r", "p", "", None, 1)], cols)
    new = spark.createDataFrame([(d, "q", "p", "", None, 7)], cols)
    assert sorted((r["query"], r.clicks) for r in facts.merge_facts(old, new).collect()) == [("q", 7), ("r", 1)]
    path = str(tmp_path / "facts")
    facts.replace_days(spark, path, old)
    facts.replace_days(spark, path, new)
    assert sorted((r["query"], r.clicks) for r in spark.read.parquet(path).collect()) == [("q", 7), ("r", 1)]
    ev = spark.createDataFrame([(dt.datetime(2024, 1, i, 5), "v", 1, 1.0) for i in (1, 1, 2, 9)], "ts timestamp, event_type string, user_id int, value double")
    ev.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    out = facts.run_once(spark, facts.daily_final(stream), "daily_final").collect()
    assert {(str(r.date), r.n) for r in out} == {("2024-01-01", 2), ("2024-01-02", 1)}


def test_days_never_lose_rows(spark, tmp_path):
    """Batches with one more column, with versions, of days not stored yet; only a missing folder counts as nothing stored."""
    d, e = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    cols = "date date, query string, page_key string, device string, country string, clicks int"
    row = lambda q, n, day=d: (day, q, "p", "", None, n)
    path = str(tmp_path / "facts")
    facts.replace_days(spark, path, spark.createDataFrame([row("q1", 1), row("q2", 1)], cols))
    facts.replace_days(spark, path, spark.createDataFrame([(*row("q3", 3), "x")], cols + ", extra string"))
    facts.replace_days(spark, path, spark.createDataFrame([row("q4", 4, e), row("q1", 5)], cols))
    got = spark.read.option("mergeSchema", True).parquet(path)
    assert sorted((r["query"], r.clicks, r.extra) for r in got.collect()) == [("q1", 5, None), ("q2", 1, None), ("q3", 3, "x"), ("q4", 4, None)]
    path = str(tmp_path / "versions")
    facts.replace_days(spark, path, spark.createDataFrame([(*row("q1", 1), 1), (*row("q1", 2), 2), (*row("q2", 1), 1)], cols + ", version int"))
    facts.replace_days(spark, path, spark.createDataFrame([(*row("q3", 3), 2), (*row("q1", 9), 1)], cols + ", version int"))
    assert sorted((r["query"], r.clicks) for r in spark.read.parquet(path).collect()) == [("q1", 2), ("q2", 1), ("q3", 3)]
    (tmp_path / "broken" / "date=2024-01-01").mkdir(parents=True)
    (tmp_path / "broken" / "date=2024-01-01" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        facts.replace_days(spark, str(tmp_path / "broken"), spark.createDataFrame([row("q1", 1)], cols))
    typed = lambda device, kind: spark.createDataFrame([(device, kind)], "device string, search_type string")
    why = lambda a, b: sorted(r.reason for r in facts.conflicts(a, b).collect())
    assert why(typed("", None), typed("", "web")) == [] and why(typed("", "web").limit(0), typed("x", "news")) == []
    assert why(typed("", "web"), typed("mobile", "news")) == ["search type", "shape"]


def test_ledger_flow(spark):
    ledger = spark.createDataFrame([("a", "x", "open", 2.0), ("b", "x", "shipped", 1.0), ("c", "y", "drafted", 1.0)], "url_key string, action string, status string, priority double")
    changes = spark.createDataFrame([("a", "x", "researching", "n1", None), ("a", "x", "drafted", "n2", None), ("b", "x", "open", "no", None), ("c", "y", None, "later", "more clicks"), ("z", "z", "open", None, None), ("c", "y", "lost", None, None)], "url_key string, action string, status string, note string, outcome string")
    got = {r.url_key: (r.status, r.note, r.outcome) for r in research.update_ledger(ledger, changes).collect()}
    assert got == {"a": ("drafted", "n1\nn2", None), "b": ("shipped", None, None), "c": ("drafted", "later", "more clicks")}
    assert {r.url_key: (r.todos, r.states) for r in research.board(ledger).collect()} == {"a": (1, "open"), "c": (1, "drafted")}


def test_sitemap_indexes(spark):
    index = "<sitemapindex><sitemap><loc>{}</loc></sitemap><sitemap><loc>{}</loc></sitemap></sitemapindex>"
    files = spark.createDataFrame([("r", index.format("a?x=1&amp;y=2", "b")), ("a?x=1&y=2", "<urlset><url><loc> http://s/&#233;?p=1&amp;q </loc><lastmod>2024-01-02T03:04</lastmod></url><url><loc>http://s/2</loc></url></urlset>"), ("b", index.format("r", "c")), ("c", "<loc>http://s/3</loc>"), ("d", "<url><loc>http://s/4</loc></url>")], "url string, value string")
    got = {r.url: str(r.lastmod) for r in crawl.sitemap_tree(files, ["r"]).collect()}
    assert got == {"http://s/é?p=1&q": "2024-01-02", "http://s/2": "None", "http://s/3": "None"}
    assert crawl.sitemap_tree(files, ["r"], max_sitemaps=2).count() == 2 and crawl.sitemap_tree(files, ["r"], max_urls=1).count() == 1


def test_what_a_crawl_leaves_out(spark):
    skip = "https://s/?q=1 https://s/?filter.x=1 https://s/a.PDF https://s/a.css?v=1 https://s/cart https://s/wp-admin/x https://s/search/ https://s/oauth/ mailto:x".split()
    keep = "https://s/ https://s/cartoon https://s/a.html https://s/?page=2 https://s/feed/ https://s/pdf".split()
    df = spark.createDataFrame([(u,) for u in skip + keep], "url string")
    assert sorted(r.url for r in df.where(crawl.crawlable(F.col("url"))).collect()) == sorted(keep)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 500])
def test_value_at_a_rank(spark, n):
    df = spark.createDataFrame([(float(i * 7 % 13),) for i in range(n)], "v double")
    want = sorted(float(i * 7 % 13) for i in range(n))[min(n - 1, int(n * 0.9))]
    assert [r.v for r in structured.at_rank(df, 0.9, 4).collect()] == [want]


def test_rewritten_files_are_read_anew(spark, data, tmp_path):
    import shutil

    shutil.copytree(data, tmp_path / "sf")
    before = ready(spark, str(tmp_path / "sf")).table("p_sa").count()
    shutil.rmtree(tmp_path / "sf" / "lineitem.parquet") if (tmp_path / "sf" / "lineitem.parquet").is_dir() else (tmp_path / "sf" / "lineitem.parquet").unlink()
    spark.read.parquet(f"{data}/lineitem.parquet").limit(100).write.parquet(str(tmp_path / "sf" / "lineitem.parquet"))
    assert ready(spark, str(tmp_path / "sf")).table("p_sa").count() < before


def test_serp_and_ledger(spark):
    items = '[{"type":"organic","rank_group":1,"domain":"x.example"},{"type":"organic","rank_group":4,"domain":"www.own.example"},{"type":"ai_overview","references":[{"url":"https://a.example/1"}],"items":[{"references":[{"url":"https://own.example/z"}]}]},{"type":"video","items":[]}]'
    r = recon.parse_serp(spark.createDataFrame([("q", items)], "query string, items string"), "own.example").first()
    assert (r.organic_rank, r.aio_present, r.aio_cites_us, r.video_present, r.n_cited) == (4, True, True, True, 2)
    ledger = spark.createDataFrame([("u", "a", "open"), ("u", "b", "shipped")], "url_key string, action string, status string")
    new = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "b")], "url_key string, action string")
    assert research.add_to_ledger(ledger, new).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "s string, n int")
    for kind in ("parquet", "csv", "json", "orc"):
        sinks.write(df, str(tmp_path / kind), kind)
        assert spark.read.option("header", True).format(kind).load(str(tmp_path / kind)).count() == 2
    assert "a\\|b" in sinks.markdown(df)
    runs = spark.createDataFrame([(i, i) for i in range(7)], "id int, at int")
    assert {r.id for r in sinks.expired(runs, "id", "at").collect()} == {0, 1}


def test_news(spark):
    rss = "<rss><item><title>Big thing - Daily</title><link>u</link><pubDate>d</pubDate></item><item><title><![CDATA[T]]></title><link>v</link><source url='x'>S</source></item></rss>"
    got = [tuple(r)[:3] for r in crawl.news_items(spark.createDataFrame([(rss,)], "value string")).collect()]
    assert got == [("Big thing", "u", "Daily"), ("T", "v", "S")]
