"""The registry as a whole, checks on a seeded property with negative controls, and pricing."""

import datetime as dt

import pytest

from crawlspan.operators import pricing, structured
from crawlspan.operators.checks import CHECKS
from crawlspan.sources.schemas import Property

DAY = dt.date(2024, 3, 31)


def test_registry():
    assert len(CHECKS) == 93
    by = lambda f: {k: sum(1 for c in CHECKS.values() if f(c) == k) for k in {f(c) for c in CHECKS.values()}}
    assert by(lambda c: c.severity) == {"crit": 4, "high": 31, "med": 32, "low": 26}
    assert by(lambda c: c.category) == {"merged": 23, "onpage": 18, "indexation": 16, "crawlability": 13, "schema": 10, "content": 5, "performance": 5, "security": 3}
    assert sum(c.certainty < 1 for c in CHECKS.values()) == 10


def page(key, **over):
    base = dict(url=f"https://s.example/{key}", url_key=f"https://s.example/{key}", status_code=200, content_type="text/html", indexable=True, noindex=False, title=f"{key} title", title_length=20, h1=f"{key} title", h1_count=1, meta_description=f"about {key}", word_count=500,
                lang="en", canonical_key=f"https://s.example/{key}", viewport="w", inlink_count=2, ipr=50, click_depth=1, depth=1, content_encoding="gzip", bytes=1000, response_time_ms=100)
    return base | over


def fact(query, key, clicks=5, impressions=100, position=5.0, date=DAY):
    return dict(date=date, query=query, page_key=f"https://s.example/{key}", device="", country="", clicks=clicks, impressions=impressions, position=position)


@pytest.fixture(scope="module")
def site(spark):
    pages = [page("ok"), page("notitle", title=" "), page("hidden", noindex=True, indexable=False), page("dead", status_code=404, indexable=False), page("twin1", title="Same"), page("twin2", title="same "), page("orphan", inlink_count=0),
             page("canon", canonical_key="https://s.example/dead", indexable=False), page("slow", response_time_ms=3000), page("list?page=2", title="Same")]
    facts = [fact("blue chair", "hidden"), fact("red chair", "orphan", impressions=400), fact("green lamp", "ok", position=15.0), fact("gone", "ghost"), fact("dead thing", "dead"), fact("early", "ok", date=DAY - dt.timedelta(28)), fact("edge", "ok", position=12.0, date=DAY - dt.timedelta(27))]
    links = [dict(source_key="https://s.example/ok", target_key="https://s.example/dead", target_url="https://s.example/dead", is_internal=True, placement="body", anchor_text="x")]
    make = lambda r: spark.createDataFrame([{k: v for k, v in x.items()} for x in r])
    import crawlspan.plans.registry as registry

    registry._AT[0] = None  # other views are under the same names now
    yield Property(spark, {"pages": make(pages), "sa": make(facts), "links": make(links), "crawl": make([dict(crawl_id="c", status="completed", urls_crawled=10)])})
    registry._AT[0] = None


def keys(spark, id):
    return {r.url_key and r.url_key.removeprefix("https://s.example/") for r in structured.build(id, spark).collect()}


@pytest.mark.parametrize(
    ("id", "want"),
    [("missing-title", {"notitle"}), ("noindex-with-traffic", {"hidden"}), ("orphan-with-impressions", {"orphan"}), ("duplicate-title", {"twin1", "twin2"}), ("broken-internal-links", {"dead"}), ("ghost-pages", {"ghost"}), ("traffic-to-dead-url", {"dead"}),
     ("broken-canonical-target", {"canon"}), ("slow-response", {"slow"}), ("striking-distance", {"ok"}), ("traffic-decay", set()), ("index-bloat", set()), ("multiple-h1", set())],
)
def test_seeded(spark, site, id, want):
    assert keys(spark, id) == want


def test_window_edges(spark, site):
    """The day 28 days back is outside, the one 27 back inside."""
    assert {r["query"] for r in structured.build("striking-distance", spark).collect()} == {"green lamp", "edge"}


def test_pricing(spark, site):
    f = pricing.run_audit(spark, ids=["missing-title", "noindex-with-traffic", "striking-distance", "slow-response"]).collect()
    assert all(r.priority > 0 for r in f)
    top = max(f, key=lambda r: r.priority)
    assert top.check_id == "noindex-with-traffic"
    one = next(r for r in f if r.check_id == "noindex-with-traffic")
    assert one.traffic == pytest.approx(max(5, 100 * 0.06)) and one["yield"] == pytest.approx(min(1, 0.8 * 1.1)) and one.effort == pytest.approx(1.0)


def test_passages(spark):
    """Where the words of the top query stand: nowhere, apart, late."""
    import crawlspan.plans.registry as registry
    from pyspark.sql import functions as F

    chunks = {"apart": ["a blue one", "an oak one"], "late": ["intro", "more", "blue oak guide at last"], "none": ["other", "things"], "fine": ["blue oak guide", "x"]}
    rows = [(f"https://s.example/{k}", [("", 2, t) for t in c]) for k, c in chunks.items()]
    pages = spark.createDataFrame(rows, "url_key string, body_chunks array<struct<heading:string,level:int,text:string>>")
    pages = pages.withColumns({"status_code": F.lit(200), "indexable": F.lit(True), "word_count": F.lit(900), "content_type": F.lit("text/html")})
    facts = spark.createDataFrame([fact("blue oak" if k == "apart" else "blue oak guide", k, impressions=500) for k in chunks], "date date, query string, page_key string, device string, country string, clicks long, impressions long, position double")
    Property(spark, {"pages": pages, "sa": facts})
    registry._AT[0] = None
    assert keys(spark, "rag-answer-gap") == {"apart"}
    assert keys(spark, "body-missing-top-query") == {"none"}
    assert keys(spark, "answer-not-front-loaded") == {"late"}


def test_brand_is_left_out(spark):
    """Pages that compete for a query, but not for one with the brand; two titles tell whether they differ on purpose."""
    import crawlspan.plans.registry as registry

    rows = [fact(q, k, impressions=200, position=p) for q in ("acme chair", "oak chair", "pine desk") for k, p in (("a", 3.0), ("b", 8.0))]
    pages = [page("a", title="Oak chair for garden rooms"), page("b", title="Oak chair for garden rooms, large")]
    make = lambda r: spark.createDataFrame(r)
    Property(spark, {"pages": make(pages), "sa": make(rows)}, brand="Acme!")
    registry._AT[0] = None
    got = {r["query"]: r.differentiated for r in structured.build("keyword-cannibalisation", spark).collect()}
    assert got == {"oak chair": False, "pine desk": False}
    Property(spark, {"pages": make([pages[0], page("b", title="Lounge seats compared")]), "sa": make(rows)})
    registry._AT[0] = None
    assert {r["query"]: r.differentiated for r in structured.build("keyword-cannibalisation", spark).collect()} == {"acme chair": True, "oak chair": True, "pine desk": True}


@pytest.mark.parametrize(
    ("kind", "html"), [("text/html", True), ("Text/HTML; charset=utf-8", True), ("application/xhtml+xml", True), ("application/json", False), ("x/text/html", False), (None, False)]
)
def test_media_types_of_html(spark, kind, html):
    import crawlspan.plans.registry as registry

    Property(spark, {"pages": spark.createDataFrame([("https://s.example/x", 200, kind)], "url_key string, status_code int, content_type string")})
    registry._AT[0] = None
    assert (keys(spark, "missing-title") == {"x"}) == html


def test_empty_property(spark):
    Property(spark, {})
    import crawlspan.plans.registry as registry

    registry._AT[0] = None
    for id in ("missing-title", "keyword-cannibalisation", "ghost-pages", "sitemap-lastmod-untrustworthy", "ai-slop-signals", "breadcrumb-schema-inconsistent"):
        assert structured.build(id, spark).count() == 0
