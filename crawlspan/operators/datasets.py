"""Dashboard datasets, one SELECT each. Averages of position here are plain means, where the checks weight by impressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import SPARK, Dialect
from .checks import D, EST, HTML, WPOS, paged, win

DATASETS: dict = {}


def dataset(name: str):
    def add(f):
        DATASETS[name] = f
        return f

    return add


NOW, OLD = win(28), win(56, 28)


def s(v: str, c: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {c} THEN {v} END), 0) AS BIGINT)"


def pair(keys: str, where: str = "true") -> str:
    return f"SELECT {keys}, {s('clicks', NOW)} AS clicks, {s('impressions', NOW)} AS impressions, avg(CASE WHEN {NOW} THEN position END) AS avg_position, {s('clicks', OLD)} AS prior_clicks, {s('impressions', OLD)} AS prior_impressions, avg(CASE WHEN {OLD} THEN position END) AS prior_position FROM p_sa WHERE {win(56)} AND {where} GROUP BY {keys}"


def percent(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN floor(({a} - {b}) * 1000e0 / {b} + 0.5) / 10 END"


dataset("summary")(lambda q: f"SELECT {s('clicks', NOW)} AS clicks, {s('impressions', NOW)} AS impressions, avg(CASE WHEN {NOW} THEN position END) AS avg_position, {s('clicks', OLD)} AS prior_clicks, {s('impressions', OLD)} AS prior_impressions, avg(CASE WHEN {OLD} THEN position END) AS prior_position, {s('clicks', NOW)} / CAST(nullif({s('impressions', NOW)}, 0) AS DOUBLE) AS ctr FROM p_sa WHERE {win(56)}")


@dataset("branded_split")
def branded(q: Dialect, brand: str = "blue"):
    b = q.contains("concat(' ', lower(query), ' ')", f"' {brand} '")
    return f"SELECT {s('clicks', f'{b} AND {NOW}')} AS brand_clicks, {s('impressions', f'{b} AND {NOW}')} AS brand_impressions, {s('clicks', f'NOT {b} AND {NOW}')} AS other_clicks, {s('impressions', f'NOT {b} AND {NOW}')} AS other_impressions, {s('clicks', f'{b} AND {OLD}')} AS prior_brand_clicks, {s('clicks', f'NOT {b} AND {OLD}')} AS prior_other_clicks FROM p_sa WHERE {win(56)}"


dataset("rank_trend")(lambda q: f"SELECT date, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, avg(position) AS avg_position FROM p_sa WHERE {win(90)} GROUP BY date")
dataset("top_keywords")(lambda q: f"SELECT query, clicks, impressions, floor(avg_position * 10 + 0.5) / 10 AS position, prior_clicks, floor(prior_position * 10 + 0.5) / 10 AS prior_position, {percent('clicks', 'prior_clicks')} AS change FROM ({pair('query', 'query IS NOT NULL')}) t WHERE impressions > 0 ORDER BY clicks DESC, query LIMIT 15")
dataset("ranking_distribution")(lambda q: f"SELECT date, {s('impressions', 'position <= 3')} AS top3, {s('impressions', 'position > 3 AND position <= 10')} AS top10, {s('impressions', 'position > 10 AND position <= 20')} AS top20, {s('impressions', 'position > 20')} AS beyond FROM p_sa WHERE {win(90)} GROUP BY date")
dataset("striking_distance")(lambda q: f"SELECT query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, avg(position) AS avg_position FROM p_sa WHERE {NOW} AND query IS NOT NULL GROUP BY query HAVING avg(position) > 10 AND avg(position) <= 20 AND sum(impressions) > 0 ORDER BY impressions DESC, query LIMIT 40")


@dataset("quick_wins")
def quick_wins(q: Dialect):
    return f"""SELECT query, clicks, impressions, position, expected, kind, CASE WHEN kind = 'striking' THEN greatest(0.0, impressions * CAST(0.032 AS DOUBLE) - clicks) ELSE greatest(0.0, impressions * expected - clicks) END AS potential FROM (
        SELECT *, CASE WHEN position > 10 THEN 'striking' WHEN clicks < 0.1 * expected * impressions THEN 'serp' WHEN clicks < 0.6 * expected * impressions THEN 'snippet' ELSE 'ok' END AS kind FROM (
        SELECT *, {q.ctr('position')} AS expected FROM (SELECT query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {WPOS} AS position FROM p_sa WHERE {NOW} AND query IS NOT NULL GROUP BY query HAVING sum(impressions) >= 50) a WHERE position <= 20) b) c ORDER BY impressions DESC, query LIMIT 300"""


dataset("device_breakdown")(lambda q: pair("device"))
dataset("country_breakdown")(lambda q: f"SELECT * FROM ({pair('country')}) t ORDER BY clicks DESC, country LIMIT 10")


@dataset("page_performance")
def page_performance(q: Dialect):
    return f"""SELECT *, CASE WHEN change >= 15 THEN 'top performer' WHEN change <= -30 THEN 'low performer' WHEN impression_change <= -20 THEN 'declining visibility' WHEN prior_impressions > 0 AND impressions > 0 AND clicks / CAST(impressions AS DOUBLE) < 0.85 * prior_clicks / CAST(prior_impressions AS DOUBLE) THEN 'improve ctr' ELSE 'stable' END AS label FROM (
        SELECT *, {percent('clicks', 'prior_clicks')} AS change, {percent('impressions', 'prior_impressions')} AS impression_change FROM ({pair('page_key', 'page_key IS NOT NULL')}) a WHERE impressions > 0) b ORDER BY clicks DESC, page_key LIMIT 40"""


dataset("content_decay")(lambda q: f"SELECT page_key, prior_clicks, clicks, prior_clicks - clicks AS lost FROM ({pair('page_key', 'page_key IS NOT NULL')}) t WHERE prior_clicks >= 10 AND clicks < 0.8 * prior_clicks ORDER BY lost DESC, page_key LIMIT 30")


@dataset("keyword_movement")
def keyword_movement(q: Dialect):
    return f"""WITH x AS (SELECT query, date, position, impressions FROM p_sa WHERE {win(90)} AND query IS NOT NULL AND impressions > 0), e AS (SELECT query, min(date) AS a, max(date) AS z, CAST(sum(impressions) AS BIGINT) AS impressions FROM x GROUP BY query HAVING sum(impressions) >= 50),
        m AS (SELECT e.query, e.impressions, avg(CASE WHEN x.date = e.a THEN x.position END) AS first_position, avg(CASE WHEN x.date = e.z THEN x.position END) AS last_position FROM e JOIN x ON x.query = e.query GROUP BY e.query, e.impressions),
        k AS (SELECT *, first_position - last_position AS gain, CASE WHEN first_position > 3 AND last_position <= 3 THEN 'entered top 3' WHEN first_position <= 3 AND last_position > 3 THEN 'dropped from top 3' WHEN first_position - last_position >= 3 THEN 'gained' WHEN last_position - first_position >= 3 THEN 'lost' END AS move FROM m)
        SELECT * FROM k WHERE move IS NOT NULL ORDER BY abs(gain) DESC, query LIMIT 40"""


BUCKET = lambda q, c: f"CASE WHEN {q.rlike(c, '/(blog|news|article)s?/')} THEN 'article' WHEN {q.rlike(c, '/(product|item|shop)s?/')} THEN 'product' WHEN {q.rlike(c, '/(category|collection|tag)s?/')} THEN 'category' WHEN {q.rlike(c, '/(docs|help|support)/')} THEN 'docs' ELSE 'page' END"
dataset("equity_scatter")(lambda q: f"SELECT p.url_key, p.ipr, coalesce(t.impressions, 0) AS impressions, coalesce(t.clicks, 0) AS clicks FROM p_pages p LEFT JOIN (SELECT page_key, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM p_sa WHERE {NOW} GROUP BY page_key) t ON t.page_key = p.url_key WHERE p.indexable AND (p.ipr >= 15 OR coalesce(t.impressions, 0) >= 5) ORDER BY p.ipr DESC, impressions DESC, p.url_key LIMIT 500")
dataset("template_mismatch")(lambda q: f"SELECT template, pages, floor(ipr * 1000e0 / nullif(sum(ipr) OVER (), 0) + 0.5) / 10 AS ipr_share, floor(clicks * 1000e0 / nullif(sum(clicks) OVER (), 0) + 0.5) / 10 AS click_share FROM (SELECT {BUCKET(q, 'p.url_key')} AS template, count(*) AS pages, CAST(sum(p.ipr) AS BIGINT) AS ipr, CAST(coalesce(sum(t.clicks), 0) AS BIGINT) AS clicks FROM p_pages p LEFT JOIN (SELECT page_key, sum(clicks) AS clicks FROM p_sa WHERE {NOW} GROUP BY page_key) t ON t.page_key = p.url_key WHERE p.indexable GROUP BY 1) g ORDER BY ipr DESC, template LIMIT 8")
FOLDER = lambda q, c: f"concat('/', split_part(split_part({c}, '?', 1), '/', 4))"
dataset("link_flows")(lambda q: f"""WITH e AS (SELECT source_key, target_key, count(*) AS n FROM p_links WHERE is_internal AND placement = 'body' AND source_key <> target_key GROUP BY source_key, target_key), o AS (SELECT *, sum(n) OVER (PARTITION BY source_key) AS outdegree FROM e)
    SELECT * FROM (SELECT {FOLDER(q, 'o.source_key')} AS source_folder, {FOLDER(q, 'o.target_key')} AS target_folder, round(sum(p.ipr * o.n / CAST(o.outdegree AS DOUBLE)), 6) AS flow FROM o JOIN p_pages p ON p.url_key = o.source_key GROUP BY 1, 2) f WHERE source_folder <> target_folder ORDER BY flow DESC, source_folder, target_folder LIMIT 24""")
dataset("top_linked_pages")(lambda q: "SELECT url_key, inlink_count, status_code FROM p_pages ORDER BY inlink_count DESC, status_code DESC NULLS LAST, url_key LIMIT 30")


@dataset("crawl_health")
def crawl_health(q: Dialect):
    band = lambda name, label: f"SELECT '{name}' AS measure, {label} AS label, count(*) AS pages FROM p_pages WHERE status_code = 200 AND {HTML} GROUP BY 2"
    est = f"({EST})"
    parts = [
        "SELECT 'status' AS measure, coalesce(CAST(CAST(floor(status_code / 100) AS BIGINT) AS STRING), 'none') AS label, count(*) AS pages FROM p_pages GROUP BY 2",
        "SELECT 'indexability' AS measure, coalesce(indexable_reason, 'indexable') AS label, count(*) AS pages FROM p_pages GROUP BY 2",
        band("speed", "CASE WHEN response_time_ms < 200 THEN 'under 200' WHEN response_time_ms < 500 THEN 'under 500' WHEN response_time_ms < 1000 THEN 'under 1000' ELSE 'slow' END"),
        band("size", f"CASE WHEN {est} < 30000 THEN 'under 30k' WHEN {est} < 60000 THEN 'under 60k' WHEN {est} < 100000 THEN 'under 100k' ELSE 'large' END"),
        band("depth", "CASE WHEN click_depth IS NULL THEN 'unreached' WHEN click_depth >= 6 THEN '6+' ELSE CAST(click_depth AS STRING) END"),
        band("title", "CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing' WHEN title_length > 60 THEN 'long' WHEN title_length < 30 THEN 'short' ELSE 'fine' END"),
        band("meta", "CASE WHEN meta_description IS NULL OR trim(meta_description) = '' THEN 'missing' WHEN meta_description_length > 155 THEN 'long' WHEN meta_description_length < 70 THEN 'short' ELSE 'fine' END"),
    ]
    return " UNION ALL ".join(parts)


dataset("duplicates")(lambda q: f"SELECT 'title' AS measure, CAST(coalesce(sum(n), 0) AS BIGINT) AS pages FROM (SELECT count(*) AS n FROM p_pages WHERE status_code = 200 AND indexable AND NOT {paged(q)} AND title IS NOT NULL AND trim(title) <> '' GROUP BY lower(trim(title)) HAVING count(*) > 1) t UNION ALL SELECT 'meta', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM p_pages WHERE status_code = 200 AND indexable AND NOT {paged(q)} AND meta_description IS NOT NULL AND trim(meta_description) <> '' GROUP BY lower(trim(meta_description)) HAVING count(*) > 1) m")
dataset("slow_pages")(lambda q: f"SELECT url_key, response_time_ms FROM p_pages WHERE status_code = 200 AND {HTML} ORDER BY response_time_ms DESC, url_key LIMIT 20")
CONTESTED = f"(SELECT query, page_key, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {WPOS} AS position FROM p_sa WHERE {win(90)} AND query IS NOT NULL AND page_key IS NOT NULL GROUP BY query, page_key)"


@dataset("cannibalisation_braids")
def braids(q: Dialect):
    week = "strftime(s.date, '%Y-%W')" if q.duck else "concat(CAST(year(s.date) AS STRING), '-', lpad(CAST(floor((dayofyear(s.date) + 6 - weekday(s.date)) / 7) AS STRING), 2, '0'))"
    return f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page_key) AS place, count(*) OVER (PARTITION BY query) AS urls, sum(impressions) OVER (PARTITION BY query) AS total FROM {CONTESTED} x WHERE position < 20 AND impressions >= 30),
        top AS (SELECT query FROM (SELECT DISTINCT query, total FROM c WHERE urls >= 2) t ORDER BY total DESC, query LIMIT 6)
        SELECT s.query, s.page_key, {week} AS week, sum(s.position * s.impressions) / nullif(sum(s.impressions), 0) AS position FROM p_sa s JOIN c ON c.query = s.query AND c.page_key = s.page_key JOIN top ON top.query = s.query WHERE c.place <= 4 AND {win(90, 0, 's.date')} GROUP BY s.query, s.page_key, 3"""


@dataset("cannibalisation_table")
def cannibalisation_table(q: Dialect):
    six = "list(page_key ORDER BY impressions DESC, page_key)[1:6]" if q.duck else "transform(slice(sort_array(collect_list(struct(-impressions AS i, page_key AS u))), 1, 6), x -> x.u)"
    return f"""WITH c AS (SELECT *, {BUCKET(q, 'page_key')} AS bucket FROM {CONTESTED} x WHERE position < 20 AND impressions >= 10)
        SELECT query, count(*) AS n_urls, CAST(sum(impressions) AS BIGINT) AS impressions, max(impressions) / CAST(sum(impressions) AS DOUBLE) AS lead_share, CASE WHEN max(impressions) >= 0.7 * sum(impressions) THEN 'dominant' ELSE 'split' END AS state, count(DISTINCT bucket) >= 2 AS cross_type, {q.join(six)} AS urls
        FROM c GROUP BY query HAVING count(*) >= 2 ORDER BY cross_type DESC, state DESC, impressions DESC, query LIMIT 40"""


dataset("trapped_authority")(lambda q: "SELECT b.url_key, b.referring_domains, p.click_depth, coalesce(b.trust_flow, least(b.referring_domains, 100)) * coalesce(p.click_depth, 6) AS score FROM p_backlinks b JOIN p_pages p ON p.url_key = b.url_key WHERE p.status_code = 200 AND b.referring_domains >= 2 AND (p.click_depth IS NULL OR p.click_depth >= 3) ORDER BY score DESC, b.url_key LIMIT 20")
dataset("growing_declining")(lambda q: f"SELECT count(CASE WHEN clicks > 1.03 * prior_clicks THEN 1 END) AS growing, count(CASE WHEN clicks < 0.97 * prior_clicks THEN 1 END) AS declining FROM ({pair('page_key', 'page_key IS NOT NULL')}) t")
dataset("date_alignment")(lambda q: f"SELECT greatest(min(date), CAST('2000-01-01' AS DATE)) AS first_day, least(max(date), {D}) AS last_day, count(DISTINCT date) AS days FROM p_sa")
dataset("link_prospects")(lambda q: "SELECT competitor AS domain, count(*) AS keywords, CAST(max(volume) AS BIGINT) AS max_volume, sum(etv) AS etv FROM p_keywords GROUP BY competitor ORDER BY keywords DESC, domain LIMIT 100")


@dataset("payload_counts")
def payload_counts(q: Dialect):
    """Every dataset's name and number of rows in one statement."""
    return " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n FROM ({f(q)}) d_{n}" for n, f in DATASETS.items() if n != "payload_counts")


def payload(spark) -> DataFrame:
    """dataset, body: every row of every dataset as JSON, the whole dashboard as one plan over the stored facts."""
    parts = [spark.sql(f(SPARK)) for n, f in DATASETS.items() if n != "payload_counts"]
    names = [n for n in DATASETS if n != "payload_counts"]
    return reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("dataset"), F.to_json(F.struct(*p.columns)).alias("body")) for n, p in zip(names, parts, strict=True)])
