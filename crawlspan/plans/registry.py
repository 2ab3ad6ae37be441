"""All registered queries of the engine and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import adhoc, crawl, demand, drift, fixes, graph, pricing, recon, research, structured, templates
from ..operators.checks import CHECKS
from ..operators.datasets import DATASETS, payload
from ..operators.relational import OPS
from ..sources import adapters, sinks
from ..streaming import facts
from . import oracles
from .dialect import DUCK, SPARK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_AT: list = [None]


def ready(spark: SparkSession, sf_dir: str) -> SparkSession:
    """Views over sf_dir, made anew when the folder, its files or the session changed since the last call."""
    at = (spark.sparkContext.applicationId, id(spark), sf_dir, adapters.stamp(spark, sf_dir))
    if _AT[0] != at:
        name = hashlib.sha256(repr(at).encode()).hexdigest()[:16]
        adapters.register(spark, sf_dir, f"{graph.shared_dir(spark)}/property-{name}")
        _AT[0] = at
    return spark


def portable(name: str, sql) -> None:
    QUERIES[name] = lambda spark, d: ready(spark, d).sql(sql(SPARK))
    ORACLE[name] = adapters.with_tables(sql(DUCK))


def framed(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, d: f(ready(spark, d))
        if oracle:
            ORACLE[name] = adapters.with_tables(oracle)
        return f

    return add


for _id, _c in CHECKS.items():
    _name = "chk_" + _id.replace("-", "_")
    if _c.sql is not None:
        portable(_name, _c.sql)
    else:
        framed(_name)(lambda spark, i=_id: structured.build(i, spark))
for _n, _f in DATASETS.items():
    portable("ds_" + _n, _f)
for _n, _f in OPS.items():
    portable("op_" + _n, _f)
# SQL written apart from the builders takes the place of theirs
ORACLE |= {"chk_" + i.replace("-", "_"): adapters.with_tables(x) for i, x in oracles.CHECKS.items()}
ORACLE |= {"ds_" + n: adapters.with_tables(x) for n, x in oracles.DATASETS.items()}
framed("ds_payload")(payload)
portable("alg_drift", drift.changes)
portable("alg_drift_staleness", drift.staleness)
portable("alg_freshness", drift.freshness)
portable("alg_recon_targets", recon.targets)
portable("alg_page_state", recon.page_state)
portable("alg_cluster_rivals", lambda q: recon.cluster_rivals(q, ["blue"]))

portable("alg_passage_bands", research.passage_bands)
portable("alg_passage_quartiles", research.passage_quartiles)

# audit: all checks run once for a session and folder, and three reports read what they found
_FOUND: list = [None, None]


def findings(spark: SparkSession) -> DataFrame:
    if _FOUND[0] != _AT[0]:
        _FOUND[:] = [_AT[0], pricing.run_audit(spark)]
    return _FOUND[1]


framed("audit_findings")(lambda s: pricing.report(findings(s)))
framed("audit_summary")(lambda s: pricing.summary(findings(s)))
framed("audit_recommendations")(lambda s: pricing.recommendations(findings(s).where("certainty >= 1")))

# graph
framed("alg_indegree", "SELECT p.url_key, CAST(coalesce(i.n, 0) AS BIGINT) AS inlink_count FROM p_pages p LEFT JOIN p_inlinks i ON i.target_key = p.url_key")(lambda s: graph.indegree(s.table("p_pages"), s.table("p_links")))
framed("alg_ipr")(lambda s: graph.ipr(s.table("p_pages"), s.table("p_links")).select("url_key", "ipr"))
SEED = adapters.key("1")
framed(
    "alg_click_depth",
    f"""SELECT p.url_key, d.click_depth FROM p_pages p LEFT JOIN (WITH RECURSIVE e AS (SELECT DISTINCT source_key, target_key FROM p_links WHERE is_internal AND placement = 'body' AND source_key <> target_key AND target_key IN (SELECT url_key FROM p_pages)),
    r(url_key, d) AS (SELECT {SEED}, 0 UNION SELECT e.target_key, r.d + 1 FROM r JOIN e ON e.source_key = r.url_key WHERE r.d < 12) SELECT url_key, CAST(min(d) AS INT) AS click_depth FROM r GROUP BY url_key) d ON d.url_key = p.url_key""",
)(lambda s: graph.click_depth(s.table("p_pages"), s.table("p_links"), s.sql(f"SELECT {SEED} AS k").first()[0]))

# crawl
framed("alg_extract")(lambda s: crawl.extract(s.table("pages"), keep=("page_id",)).select("page_id", "url", "title", "h1", "h1_count", "lang", "charset", "word_count", "internal_links", "external_links", F.size("body_chunks").alias("chunks"), "heading_skips", "noindex"))
framed("alg_extract_links")(lambda s: crawl.extract(s.table("pages"), keep=("page_id",)).select("page_id", F.explode("links").alias("l")).select("page_id", "l.*"))
framed("alg_indexability", "SELECT url_key, indexable_reason AS reason FROM p_pages WHERE status_code IS NOT NULL")(lambda s: s.table("p_pages").where("status_code IS NOT NULL").select("url_key", crawl.indexability(F.col("status_code"), F.col("content_type"), F.col("x_robots_tag"), F.col("noindex"), F.col("canonical_key"), F.col("url_key")).alias("reason")))
framed("alg_url_key")(lambda s: s.table("pages").select("page_id", "url", urls.url_key(F.col("url"), "apex").alias("url_key")))
framed("alg_morphology")(lambda s: s.table("pages").select("page_id", urls.morphology(F.col("url")).alias("shape")))
framed("alg_crawlable")(lambda s: s.table("pages").where(crawl.crawlable(F.col("url"))).select("page_id", "url"))
ROBOTS = "User-agent: *\nDisallow: /product/\nAllow: /product/item-1\nDisallow: /docs"
framed("alg_robots", "SELECT url_key, NOT (contains(url_key, 'example/docs') OR (contains(url_key, 'example/product/') AND NOT contains(url_key, 'example/product/item-1'))) AS allowed FROM p_pages")(lambda s: crawl.allowed(s.table("p_pages").select("url_key", urls.path_of(F.col("url_key")).alias("path")), s.createDataFrame(crawl.robots_rules(ROBOTS, "audit"), "path string, allow boolean")).select("url_key", "allowed"))
framed("alg_templates")(lambda s: templates.templates(s))
framed("alg_sitemap", "SELECT url_key AS url, lastmod FROM p_sitemap")(lambda s: crawl.sitemap_urls(s.table("p_sitemap").select(F.concat(F.lit("<urlset><url><loc> "), F.replace("url_key", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), F.coalesce(F.col("lastmod").cast("string"), F.lit("")), F.lit("</lastmod></url></urlset>")).alias("value"))))

# demand
framed("alg_opportunities")(lambda s: demand.opportunities(s))
framed("alg_topic_gaps")(lambda s: demand.topic_gaps(s))
framed("alg_keyword_list")(lambda s: demand.keyword_list(s, s.sql("SELECT DISTINCT keyword FROM p_keywords")))
framed("alg_market_size", "SELECT competitor AS domain, count(DISTINCT lower(keyword)) AS keywords, sum(etv) AS etv, sum(etv) * 100 / (SELECT sum(etv) FROM p_keywords) AS share_of_voice FROM p_keywords GROUP BY competitor")(lambda s: demand.market_size(s))
framed("alg_market_topics")(lambda s: demand.market_topics(s))
framed("alg_serp_footprint")(lambda s: demand.serp_footprint(s))

# recon and fixes
SERPS = """SELECT p_name AS query, concat('[{"type":"organic","rank_group":', CAST(p_size % 12 + 1 AS STRING), ',"domain":"', CASE p_size % 2 WHEN 0 THEN 'www.site.example' ELSE 'other.example' END, '","url":"u"},{"type":"ai_overview","references":[{"url":"https://site.example/a"}]}]') AS items FROM (SELECT p_name, min(p_size) AS p_size FROM part GROUP BY p_name) t"""
framed("alg_serp_verdict")(lambda s: recon.parse_serp(s.sql(SERPS), "site.example"))


@framed("alg_todos")
def todos(s):
    t = s.sql(recon.targets(SPARK)).join(recon.parse_serp(s.sql(SERPS), "site.example"), "query", "left").join(s.sql(recon.page_state(SPARK)).select("url_key", "cannot_rank"), "url_key", "left")
    t = t.withColumn("verdict", F.when(F.col("cannot_rank"), "page-cannot-rank").otherwise(F.coalesce("verdict", F.lit("competitive-gap"))))
    return recon.todos(t.withColumn("has_product_schema", F.lit(False)))


framed("alg_redirect_targets")(lambda s: fixes.redirect_targets(s))
framed("alg_flat_chains")(lambda s: fixes.flat_chains(s))
framed("alg_link_donors")(lambda s: fixes.link_donors(s))
framed("alg_markup_stubs")(lambda s: fixes.markup_stubs(s))
framed("alg_readiness", "SELECT n_name AS origin, CAST(floor(count_if(s_acctbal > 0) * 100 / count(*) + 0.5) AS INT) AS score, CAST(count_if(s_acctbal > 0) AS BIGINT) AS passed, count(*) AS probes, CASE WHEN floor(count_if(s_acctbal > 0) * 100 / count(*) + 0.5) >= 80 THEN 'ready' WHEN floor(count_if(s_acctbal > 0) * 100 / count(*) + 0.5) >= 50 THEN 'partial' WHEN floor(count_if(s_acctbal > 0) * 100 / count(*) + 0.5) >= 20 THEN 'minimal' ELSE 'none' END AS level FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")(
    lambda s: sinks.readiness(s.table("supplier").join(s.table("nation"), F.expr("n_nationkey = s_nationkey")).select(F.col("n_name").alias("origin"), F.lit("c").alias("category"), (F.col("s_acctbal") > 0).alias("passed")))
)

# research
MONTHLY = """SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, {}, sum(o_totalprice) AS etv FROM (SELECT *, o_orderkey % 100 + 1 AS pos FROM orders) o GROUP BY 1, 2"""
EDGES = {"pos_1": (1, 1), "pos_2_3": (2, 3), "pos_4_10": (4, 10), "pos_11_20": (11, 20), **{f"pos_{i}1_{i + 1}0": (10 * i + 1, 10 * i + 10) for i in range(2, 9)}, "pos_91_100": (91, 100)}
framed("alg_rank_history", "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(CASE WHEN pos <= 3 THEN 1 END) AS pos_1_3, count(CASE WHEN pos BETWEEN 4 AND 10 THEN 1 END) AS pos_4_10, count(CASE WHEN pos BETWEEN 11 AND 20 THEN 1 END) AS pos_11_20, count(CASE WHEN pos > 20 THEN 1 END) AS pos_21_100, round(sum(o_totalprice), 2) AS etv, count(*) AS keyword_count FROM (SELECT *, o_orderkey % 100 + 1 AS pos FROM orders) o GROUP BY 1")(
    lambda s: research.rank_history(s.sql(MONTHLY.format(", ".join(f"count_if(pos BETWEEN {a} AND {z}) AS {n}" for n, (a, z) in EDGES.items())))).withColumn("etv", F.round("etv", 2))
)
HOSTS = ("https://www.youtube.com/watch?v=1", "http://m.youtu.be/x", "https://old.reddit.com/r/a", "https://redd.it/b", "https://pimax.com/p", "x.com/post", "https://notreddit.com/", "https://user@vimeo.com:443/9")
framed("alg_routes", "SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'video' WHEN 1 THEN 'video' WHEN 2 THEN 'reddit' WHEN 3 THEN 'reddit' WHEN 5 THEN 'video' WHEN 7 THEN 'video' ELSE 'page' END AS route FROM supplier")(lambda s: s.table("supplier").select("s_suppkey", research.route(F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("s_suppkey") % 8 + 1).cast("int"))).alias("route")))
STATED = "SELECT url_key, concat('act ', CAST(k % 3 AS STRING)) AS action, CASE k % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'researching' WHEN 2 THEN 'drafted' WHEN 3 THEN 'shipped' ELSE 'dismissed' END AS status, CAST(k AS DOUBLE) AS priority FROM p_base"
framed("alg_ledger", """SELECT url_key, 'act ' || (k % 3) AS action, CASE WHEN k % 5 >= 3 THEN CASE k % 5 WHEN 3 THEN 'shipped' ELSE 'dismissed' END WHEN k % 7 = 0 THEN 'shipped' WHEN k % 5 = 0 THEN 'open' WHEN k % 5 = 1 THEN 'researching' ELSE 'drafted' END AS status, CAST(k AS DOUBLE) AS priority,
    CASE WHEN k % 7 = 0 AND k % 5 < 3 THEN 'live' END AS outcome FROM p_base UNION ALL SELECT url_key, 'act ' || (k % 3), 'open', 1.0, NULL FROM p_base WHERE k % 2 = 0 AND (k % 5 >= 3 OR k % 7 = 0)""")(
    lambda s: research.add_to_ledger(research.update_ledger(s.sql(STATED), s.sql("SELECT url_key, concat('act ', CAST(k % 3 AS STRING)) AS action, 'shipped' AS status, CAST(NULL AS STRING) AS note, 'live' AS outcome FROM p_base WHERE k % 7 = 0")), s.sql("SELECT url_key, concat('act ', CAST(k % 3 AS STRING)) AS action, CAST(1 AS DOUBLE) AS priority FROM p_base WHERE k % 2 = 0")).select("url_key", "action", "status", "priority", "outcome")
)
framed("alg_ledger_board", "SELECT url_key, 1 AS todos, CAST(k AS DOUBLE) AS priority, CASE k % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'researching' ELSE 'drafted' END AS states FROM p_base WHERE k % 5 < 3")(lambda s: research.board(s.sql(STATED)))
framed("list_checks", f"SELECT count(*) AS checks, count(DISTINCT id) AS ids FROM (VALUES {', '.join(f'({chr(39)}{i}{chr(39)})' for i in sorted(CHECKS))}) t(id)")(lambda s: pricing.metadata(s).agg(F.count(F.lit(1)).alias("checks"), F.countDistinct("check_id").alias("ids")))
framed("table_sizes", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("p_sa", "p_pages", "p_links")))(lambda s: sinks.table_sizes({t: s.table(t) for t in ("p_sa", "p_pages", "p_links")}))

# ad hoc
framed("adhoc_paging", "SELECT count(*) AS total, least(50, greatest(0, count(*) - 100)) AS returned, CASE WHEN count(*) > 150 THEN 150 END AS next_offset FROM p_pages WHERE status_code = 200")(lambda s: adhoc.paging(s, "pages", (("status_code", "eq", 200),), 50, 100))
framed("adhoc_aggregate", "SELECT device, count(*) AS count, CAST(sum(clicks) AS BIGINT) AS sum_clicks, round(avg(position), 2) AS avg_position, floor(count(*) * 1000e0 / (SELECT count(*) FROM p_sa WHERE impressions >= 100) + 0.5) / 10 AS pct FROM p_sa WHERE impressions >= 100 GROUP BY device")(
    lambda s: adhoc.query_data(s, "sa", group_by=("device",), metrics=(("sum", "clicks"), ("avg", "position")), filters=(("impressions", "gte", 100),))
)
framed("adhoc_top", "SELECT query, count(*) AS count, CAST(sum(impressions) AS BIGINT) AS sum_impressions, floor(count(*) * 1000e0 / (SELECT count(*) FROM p_sa) + 0.5) / 10 AS pct FROM p_sa GROUP BY query ORDER BY sum_impressions DESC, query LIMIT 10")(
    lambda s: adhoc.query_data(s, "sa", group_by=("query",), metrics=(("sum", "impressions"),), order_by="sum_impressions", limit=10)
)
framed("adhoc_rows", "SELECT url_key, title, word_count FROM p_pages WHERE title ILIKE '%GUIDE%' AND status_code IN (200, 404) ORDER BY word_count DESC NULLS LAST, url_key, title LIMIT 50")(
    lambda s: adhoc.query_data(s, "pages", "rows", columns=("url_key", "title", "word_count"), filters=(("title", "like", "%GUIDE%"), ("status_code", "in", [200, 404])), order_by="word_count")
)

# streaming, by their batch equivalents and by a stream run to its end
framed("stream_daily", "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda s: facts.daily_final(s.table("events")).select("date", "event_type", "n"))
framed("stream_sliding")(lambda s: facts.sliding(s.table("events")))
framed("stream_sessions")(lambda s: facts.sessions(s.table("events")))
framed("stream_merge", "SELECT CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS clicks FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT DISTINCT CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, 0 FROM lineitem WHERE l_orderkey % 10 = 0")(
    lambda s: facts.merge_facts(s.sql("SELECT CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS clicks FROM lineitem"), s.sql("SELECT CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, CAST(0 AS BIGINT) AS clicks FROM lineitem WHERE l_orderkey % 10 = 0"), ("date", "l_orderkey", "l_linenumber"))
)
framed("stream_first_snapshots", "SELECT DISTINCT crawl_id, url_key FROM p_snapshots")(lambda s: facts.first_snapshots(s.table("p_snapshots")).select("crawl_id", "url_key"))
