"""Research targets: which pages to work on, what their result pages say, what to do, and the ledger of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import SPARK, Dialect
from .checks import WPOS, periods, win

# Weight of a to-do's type and headroom of a verdict.
TYPE_WEIGHT = {"content-gap": 1.0, "schema": 0.9, "research": 0.8, "cannibalisation": 0.7, "format": 0.6, "freshness": 0.3}
HEADROOM = {"competitive-gap": 1.0, "accuracy-or-freshness": 1.0, "consolidate-weak-page": 0.9, "page-cannot-rank": 0.8, "defend-and-deepen": 0.4}


def targets(q: Dialect) -> str:
    """Top query of each page at positions 3 to 15 with 300 impressions, its slip since the month before, and how many own URLs compete."""
    return f"""WITH x AS (SELECT * FROM ({periods('page_key, query')}) p WHERE query IS NOT NULL AND cur_impr > 0), top AS (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY cur_impr DESC, query) AS n FROM x),
        rivals AS (SELECT query, count(*) AS urls FROM x WHERE cur_impr >= 10 GROUP BY query)
        SELECT t.page_key AS url_key, t.query, t.cur_pos AS position, t.cur_impr AS impressions, t.cur AS clicks, t.prev_pos AS prior_position, coalesce(t.cur_pos - t.prev_pos > 0.5, false) AS slipped, r.urls AS competing_urls
        FROM top t JOIN rivals r ON r.query = t.query WHERE t.n = 1 AND t.cur_pos >= 3 AND t.cur_pos <= 15 AND t.cur_impr >= 300 ORDER BY t.cur_impr DESC, t.page_key LIMIT 50"""


def page_state(q: Dialect) -> str:
    """Crawl facts that overrule what search data says: a page that can't rank."""
    return "SELECT url_key, status_code, indexable, indexable_reason, canonical_key, inlink_count, ipr, (indexable IS NOT NULL AND NOT indexable) OR coalesce(canonical_key <> url_key, false) AS cannot_rank FROM p_pages"


def opportunity(impressions: Column, rank: Column, position: Column) -> Column:
    """Clicks to gain at a realistic target: position 1 from the top 3, 3 from the first page, else 8."""
    at = F.greatest(F.lit(1.0), F.coalesce(rank, position))
    curve = lambda c: F.element_at(F.array(*[F.lit(x) for x in (0.28, 0.15, 0.11, 0.08, 0.06, 0.05, 0.04, 0.032, 0.028, 0.025)]), F.greatest(F.lit(1), F.least(F.lit(10), F.floor(c + 0.5).cast("int"))))
    goal = F.when(at <= 3, 1.0).when(at <= 10, 3.0).otherwise(8.0)
    return F.greatest(F.lit(0.0), impressions * (curve(goal) - curve(at)))


SERP = """array<struct<type:string,rank_group:int,domain:string,url:string,title:string,asynchronous_ai_overview:boolean,references:array<struct<url:string,domain:string,title:string>>,
items:array<struct<url:string,title:string,source:string,references:array<struct<url:string,domain:string,title:string>>>>>>"""


def host_of(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^[a-z]+://", ""), r"^www\.|[/?#:].*$", "")


def parse_serp(serps: DataFrame, own: str) -> DataFrame:
    """(query, items JSON) -> own organic rank, AI overview and who it cites, video, and a verdict."""
    s = serps.withColumn("i", F.from_json("items", SERP))
    of = lambda *t: F.filter("i", lambda x: x["type"].isin(*t))
    ours = F.filter(of("organic"), lambda x: host_of(F.coalesce(x["domain"], x["url"])) == own)
    overview = of("ai_overview")
    refs = F.flatten(F.transform(overview, lambda o: F.concat(F.coalesce(o["references"], F.array()), F.flatten(F.transform(F.coalesce(o["items"], F.array()), lambda e: F.coalesce(e["references"], F.array()))))))
    urls = F.array_distinct(F.filter(F.transform(refs, lambda r: r["url"]), lambda u: u.isNotNull() & (u != "")))
    s = s.select("query", F.get(F.transform(ours, lambda x: x["rank_group"]), F.lit(0)).alias("organic_rank"), (F.size(overview) > 0).alias("aio_present"), F.exists(overview, lambda o: F.coalesce(o["asynchronous_ai_overview"], F.lit(False))).alias("later"), urls.alias("cited"), (F.size(of("video", "short_videos")) > 0).alias("video_present"))
    cites = F.when(~F.col("aio_present"), F.lit(None).cast("boolean")).when(F.col("later") & (F.size("cited") == 0), F.lit(None).cast("boolean")).otherwise(F.exists("cited", lambda u: host_of(u) == own))
    s = s.withColumn("aio_cites_us", cites)
    verdict = F.when(F.col("organic_rank").isNull(), "consolidate-weak-page").when(F.coalesce("aio_cites_us", F.lit(False)), "defend-and-deepen").when(F.col("organic_rank") <= 5, F.when(F.col("aio_present"), "accuracy-or-freshness").otherwise("defend-and-deepen")).otherwise("competitive-gap")
    return s.select("query", "organic_rank", "aio_present", "aio_cites_us", "video_present", F.size("cited").alias("n_cited"), verdict.alias("verdict"))


def cluster_rivals(q: Dialect, core: list[str]) -> str:
    """URLs that compete on any query with all core tokens."""
    has = " AND ".join(f"query LIKE '%{t}%'" for t in core[:4])
    return f"""WITH x AS (SELECT query, page_key, CAST(sum(impressions) AS BIGINT) AS impressions, {WPOS} AS position FROM p_sa WHERE {win()} AND page_key IS NOT NULL AND {has} GROUP BY query, page_key), y AS (SELECT *, max(impressions) OVER (PARTITION BY query) AS lead FROM x)
        SELECT page_key AS url_key, count(DISTINCT query) AS queries, CAST(sum(impressions) AS BIGINT) AS impressions FROM y WHERE impressions >= 10 AND impressions >= 0.1 * lead AND position < 20 GROUP BY page_key"""


def todos(facts: DataFrame) -> DataFrame:
    """(url_key, query, verdict, impressions, position, organic_rank, aio_present, aio_cites_us, video_present, has_product_schema, competing_urls) -> one row per to-do, with its priority."""
    price = lambda kind: F.floor(opportunity(F.col("impressions"), F.col("organic_rank"), F.col("position")) * F.coalesce(F.create_map(*[F.lit(x) for kv in HEADROOM.items() for x in kv])[F.col("verdict")], F.lit(1.0)) * TYPE_WEIGHT[kind] * 100 + 0.5) / 100
    commercial = F.col("query").rlike(r"(?i)\b(best|top|vs|review|compare|comparison|cheap|budget|buy)\b")
    rules = [
        ("resolve the duplicate or index status", "cannibalisation", F.col("verdict") == "page-cannot-rank"),
        ("fill the gap to the pages above", "content-gap", F.col("verdict") == "competitive-gap"),
        ("check facts and dates", "freshness", F.col("verdict") == "accuracy-or-freshness"),
        ("earn a citation in the overview", "content-gap", F.col("aio_present") & ~F.coalesce("aio_cites_us", F.lit(False))),
        ("add product markup", "schema", commercial & ~F.coalesce("has_product_schema", F.lit(False))),
        ("add a video", "format", F.col("video_present")),
        ("merge competing pages", "cannibalisation", F.col("competing_urls") >= 2),
    ]
    made = F.array(*[F.when(c, F.struct(F.lit(a).alias("action"), F.lit(k).alias("type"), price(k).alias("priority"))) for a, k, c in rules])
    return facts.select("url_key", "query", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("todo")).select("url_key", "query", "todo.action", "todo.type", "todo.priority")


__all__ = ["SPARK", "cluster_rivals", "opportunity", "page_state", "parse_serp", "targets", "todos"]
