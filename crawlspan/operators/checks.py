"""The check registry: metadata and one SELECT per check.

A builder gets a dialect and returns SQL over a property's views (p_pages, p_sa ...). Every check gives
url_key (null for site- or query-level findings) and its evidence columns; query, clicks, impressions
and position are evidence that pricing reads by name. Tops have a total order, so results are repeatable.
Checks over structured data that need recursive JSON are in ``structured.py`` and share this registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..plans.dialect import Dialect

D = "(SELECT day FROM p_day)"
# Media types of HTML.
HTML = "(lower(content_type) LIKE 'text/html%' OR lower(content_type) LIKE 'application/xhtml+xml%')"
OK = f"status_code = 200 AND {HTML}"
WPOS = "sum(position * impressions) / nullif(sum(impressions), 0)"


@dataclass(frozen=True)
class Check:
    id: str
    category: str
    severity: str
    labels: str
    certainty: float
    effort: float
    fix: str
    sql: Callable[[Dialect], str]
    #: Column that findings of the check are capped by, largest first (else url_key).
    top: str | None = None


CHECKS: dict[str, Check] = {}


def check(id: str, category: str, severity: str, labels: str, effort: float, fix: str, certainty: float = 1.0, top: str | None = None):
    def add(f):
        CHECKS[id] = Check(id, category, severity, labels, certainty, effort, fix, f, top)
        return f

    return add


def rule(id: str, category: str, severity: str, effort: float, fix: str, where: str, evidence: str = "", labels: str = "D", certainty: float = 1.0, top: str | None = None) -> None:
    """A check that is one filter over pages."""
    check(id, category, severity, labels, effort, fix, certainty, top)(lambda q, w=where, e=evidence: f"SELECT url_key{', ' * bool(e)}{e} FROM p_pages WHERE {w(q) if callable(w) else w}")


def win(days: int = 28, after: int = 0, date: str = "date") -> str:
    """(d - days, d - after] for the finalised day d."""
    return f"{date} <= {D} - INTERVAL {after} DAY AND {date} > {D} - INTERVAL {days} DAY"


def span(q: Dialect, days: int) -> str:
    between = "date_diff('day', min(date), max(date))" if q.duck else "datediff(max(date), min(date))"
    return f"(SELECT {between} FROM p_sa) >= {days}"


def paged(q: Dialect, col: str = "url_key") -> str:
    return q.rlike(col, "/page/[0-9]|[?&]page=[0-9]|[?&]paged=[0-9]")


#: Leaves out queries that have the property's brand as a word; without a brand, none.
NO_BRAND = "NOT coalesce(contains(concat(' ', lower(query), ' '), concat(' ', (SELECT max(brand) FROM p_brand), ' ')), false)"


def totals(where: str, keys: str = "page_key", more: str = "") -> str:
    return f"SELECT {keys}, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {WPOS} AS position{more} FROM p_sa WHERE {where} GROUP BY {keys}"


def periods(keys: str) -> str:
    """Current and previous 28 days in one scan."""
    now = f"date > {D} - INTERVAL 28 DAY"
    s = lambda v, c, n: f"CAST(coalesce(sum(CASE WHEN {c} THEN {v} END), 0) AS BIGINT) AS {n}"
    w = lambda c, n: f"sum(CASE WHEN {c} THEN position * impressions END) / nullif(sum(CASE WHEN {c} THEN impressions END), 0) AS {n}"
    old = f"NOT ({now})"
    return f"SELECT {keys}, {s('clicks', now, 'cur')}, {s('clicks', old, 'prev')}, {s('impressions', now, 'cur_impr')}, {s('impressions', old, 'prev_impr')}, {w(now, 'cur_pos')}, {w(old, 'prev_pos')}, count(CASE WHEN {now} THEN 1 END) AS cur_rows, count(CASE WHEN {old} THEN 1 END) AS prev_rows FROM p_sa WHERE {win(56)} AND {keys.split(',')[0]} IS NOT NULL GROUP BY {keys}"


def top_query(where: str = "true") -> str:
    return f"SELECT page_key, query, impr FROM (SELECT page_key, query, CAST(sum(impressions) AS BIGINT) AS impr, row_number() OVER (PARTITION BY page_key ORDER BY sum(impressions) DESC, query) AS rn FROM p_sa WHERE query IS NOT NULL AND page_key IS NOT NULL AND {win()} AND {where} GROUP BY page_key, query) t WHERE rn = 1"


# filters over pages
IDX = "indexable"
rule("missing-title", "onpage", "crit", 1, "per-page", f"{OK} AND (title IS NULL OR trim(title) = '')")
rule("missing-meta-description", "onpage", "med", 1, "per-page", lambda q: f"status_code = 200 AND {IDX} AND NOT {paged(q)} AND (meta_description IS NULL OR trim(meta_description) = '')")
rule("missing-h1", "onpage", "med", 3, "per-page", f"status_code = 200 AND {IDX} AND (h1_count IS NULL OR h1_count = 0)")
rule("multiple-h1", "onpage", "low", 3, "per-page", "status_code = 200 AND h1_count > 1", "h1_count")
rule("thin-content", "content", "med", 5, "per-page", f"status_code = 200 AND {IDX} AND word_count < 200", "word_count", "D+N", 0.6)
rule("image-alt", "onpage", "low", 3, "per-page", f"{IDX} AND images_without_alt > 0", "images_without_alt AS missing, image_count AS total")
rule("canonical-relative", "indexation", "med", 1, "per-page", "status_code = 200 AND canonical_relative", "canonical_url AS canonical")
rule("multiple-canonical", "indexation", "high", 1, "per-page", "status_code = 200 AND canonical_count > 1", "canonical_count")
rule("images-missing-dimensions", "onpage", "low", 3, "per-page", f"{IDX} AND images_missing_dimensions > 0", "images_missing_dimensions AS missing_dimensions, image_count AS total")
rule("heading-hierarchy", "onpage", "low", 3, "per-page", f"{IDX} AND heading_skips > 0", "heading_skips AS skipped_levels")
rule("mixed-content", "security", "high", 3, "per-page", "status_code = 200 AND url ILIKE 'https://%' AND mixed_content_count > 0", "mixed_content_count AS insecure_resources")
rule("meta-nofollow", "crawlability", "med", 1, "per-page", f"{IDX} AND robots ILIKE '%nofollow%'", "robots")
rule("missing-social-tags", "onpage", "low", 1, "per-page", f"{IDX} AND coalesce(og_tags, 0) = 0 AND coalesce(twitter_tags, 0) = 0")
check("missing-hsts", "security", "low", "D", 1, "global")(lambda q: f"SELECT min(url_key) AS url_key FROM p_pages WHERE {OK} AND has_hsts IS NOT NULL AND NOT has_hsts HAVING count(*) > 0")
rule("title-too-long", "onpage", "low", 1, "per-page", f"{IDX} AND title_length > 60", "title_length")
rule("meta-description-length", "onpage", "low", 1, "per-page", f"{IDX} AND meta_description_length > 160", "meta_description_length AS length")
rule("non-https", "security", "high", 3, "global", "status_code = 200 AND url ILIKE 'http://%'", "url")
rule("redirect-chain", "crawlability", "med", 3, "automated", lambda q: f"redirects IS NOT NULL AND {q.size('redirects')} >= 2")
rule("missing-structured-data", "schema", "low", 5, "per-page", lambda q: f"{IDX} AND (json_ld IS NULL OR {q.size('json_ld')} = 0) AND NOT coalesce(has_microdata, false) AND NOT coalesce(has_rdfa, false)")
rule("missing-viewport", "onpage", "med", 3, "global", f"{OK} AND (viewport IS NULL OR viewport = '')")
rule("weak-passage-answer", "merged", "high", 5, "per-page", f"{IDX} AND max_passage_score < 3", "max_passage_query AS top_query, max_passage_score, coalesce(max_passage_impr, 0) AS impressions", "G+N", 0.8)
rule("deep-pages", "crawlability", "med", 3, "per-page", f"{IDX} AND click_depth >= 4", "click_depth", top="click_depth")
rule("slow-response", "performance", "med", 5, "global", f"{OK} AND response_time_ms > 1500", "response_time_ms AS response_ms", top="response_ms")
rule("uncompressed-html", "performance", "med", 1, "global", f"{OK} AND (content_encoding IS NULL OR content_encoding = '')")
PACKED = "lower(coalesce(content_encoding, '')) IN ('br', 'gzip', 'deflate', 'zstd')"
EST = f"CASE WHEN {PACKED} THEN CAST(floor(bytes * 0.22 + 0.5) AS BIGINT) ELSE bytes END"
rule("large-html", "performance", "low", 5, "per-page", f"{OK} AND bytes > 60000 AND {EST} > 60000", f"bytes AS raw_bytes, {EST} AS est_transfer_bytes, {PACKED} AS compressed", top="est_transfer_bytes")
check("missing-lang", "onpage", "low", "D", 1, "global")(lambda q: f"SELECT CAST(NULL AS STRING) AS url_key, count(*) AS pages FROM p_pages WHERE {IDX} AND {HTML} AND (lang IS NULL OR lang = '') HAVING count(*) > 0")
check("image-preview-restricted", "indexation", "low", "D", 1, "per-page")(lambda q: f"SELECT url_key, robots FROM p_pages WHERE {IDX} AND {q.rlike("replace(lower(coalesce(robots, '')), ' ', '')", 'max-image-preview:(none|standard)')} ORDER BY url_key LIMIT 50")
check("excessive-links", "onpage", "low", "D", 3, "per-page", top="total")(lambda q: f"SELECT url_key, internal_links, external_links, internal_links + external_links AS total FROM p_pages WHERE {IDX} AND internal_links + external_links > 300 ORDER BY total DESC, url_key LIMIT 30")
check("favicon-missing", "onpage", "low", "D", 1, "global")(lambda q: f"SELECT url_key FROM (SELECT url_key, has_favicon FROM p_pages WHERE {OK} AND has_favicon IS NOT NULL ORDER BY depth NULLS LAST, inlink_count DESC NULLS LAST, url_key LIMIT 1) h WHERE NOT has_favicon")
check("no-304-revalidation", "performance", "low", "D", 1, "global")(lambda q: "SELECT CAST(NULL AS STRING) AS url_key, count(*) AS probed, CAST(0 AS BIGINT) AS honoured304 FROM p_pages WHERE conditional_304 IS NOT NULL HAVING count(*) >= 5 AND sum(CASE WHEN conditional_304 THEN 1 ELSE 0 END) = 0")
check("analytics-missing", "onpage", "med", "D", 1, "global")(lambda q: f"SELECT CAST(NULL AS STRING) AS url_key, count(*) AS pages_checked FROM p_pages WHERE {OK} AND has_analytics IS NOT NULL HAVING count(*) >= 3 AND sum(CASE WHEN has_analytics THEN 1 ELSE 0 END) = 0")
HEADED = lambda q: q.size(q.filter("body_chunks", "c", "c.heading IS NOT NULL AND c.heading <> '' AND c.level >= 2"))
rule("poor-chunkability", "content", "low", 3, "per-page", lambda q: f"{OK} AND {IDX} AND word_count >= 400 AND body_chunks IS NOT NULL AND {HEADED(q)} <= 1", "word_count")
check("content-bloat", "content", "low", "D+N", 5, "per-page", 0.6)(lambda q: f"SELECT * FROM (SELECT url_key, word_count, {HEADED(q)} AS headed_sections, CAST(floor(word_count / CAST(greatest(1, {HEADED(q)}) AS DOUBLE) + 0.5) AS BIGINT) AS words_per_section FROM p_pages WHERE {OK} AND {IDX} AND word_count >= 2500 AND body_chunks IS NOT NULL) s WHERE words_per_section > 500")
# Fixed value: openings that lean on the text before.
LEANS = "^(it|this|that|these|those|they|he|she|there|here|such|one)([^a-z0-9_]|$)"


@check("low-extractability", "content", "low", "D+N", 3, "per-page", 0.5)
def low_extractability(q):
    long = q.filter("body_chunks", "c", "length(c.text) > 60")
    leans = q.filter("body_chunks", "c", f"length(c.text) > 60 AND {q.rlike('lower(trim(c.text))', LEANS)}")
    return f"SELECT * FROM (SELECT url_key, {q.size(leans)} AS dependent_sections, {q.size(long)} AS total_sections FROM p_pages WHERE status_code = 200 AND {IDX} AND word_count >= 400 AND body_chunks IS NOT NULL) s WHERE total_sections >= 3 AND dependent_sections * 2 >= total_sections"


def repeated(col: str, name: str):
    return lambda q: f"SELECT url_key, {name} FROM (SELECT url_key, {col} AS {name}, count(*) OVER (PARTITION BY lower(trim({col}))) AS n FROM p_pages WHERE status_code = 200 AND {IDX} AND NOT {paged(q)} AND {col} IS NOT NULL AND trim({col}) <> '') t WHERE n > 1"


check("duplicate-title", "onpage", "high", "D", 3, "per-page")(repeated("title", "title"))
check("duplicate-meta-description", "onpage", "low", "D", 3, "per-page")(repeated("meta_description", "meta_description"))
check("title-h1-mismatch", "onpage", "low", "D", 1, "per-page")(lambda q: f"SELECT url_key, title, h1 FROM p_pages WHERE {IDX} AND {q.size(q.terms('title'))} >= 2 AND {q.size(q.terms('h1'))} >= 2 AND {q.size(q.common(q.terms('title'), q.terms('h1')))} = 0")

# links
DEAD = "status_code >= 400 AND status_code NOT IN (429, 503)"
check("broken-internal-links", "crawlability", "crit", "D", 3, "automated", top="linking_pages")(lambda q: f"SELECT p.url_key, p.status_code AS status, count(DISTINCT l.source_key) AS linking_pages FROM p_pages p JOIN p_links l ON l.target_key = p.url_key WHERE l.is_internal AND p.{DEAD.replace('AND status', 'AND p.status')} GROUP BY p.url_key, p.status_code")
check("internal-links-to-redirects", "crawlability", "med", "D", 3, "automated", top="linking_pages")(lambda q: f"SELECT r.src AS url_key, count(DISTINCT l.source_key) AS linking_pages FROM (SELECT DISTINCT h.x.{'"from"' if q.duck else '`from`'} AS src FROM p_pages, {q.unnest('redirects', 'h')}) r JOIN (SELECT source_key, {'split_part' if q.duck else 'split_part'}(target_url, '#', 1) AS href FROM p_links WHERE is_internal) l ON l.href = r.src GROUP BY r.src")
check("ipr-bleed-by-status", "crawlability", "high", "D", 3, "automated", top="wasted_ipr")(lambda q: f"SELECT t.url_key, t.status_code AS status, count(DISTINCT l.source_key) AS linking_pages, CAST(sum(s.ipr) AS BIGINT) AS wasted_ipr FROM p_links l JOIN p_pages s ON s.url_key = l.source_key JOIN p_pages t ON t.url_key = l.target_key WHERE l.is_internal AND t.status_code >= 400 AND t.status_code NOT IN (429, 503) GROUP BY t.url_key, t.status_code HAVING sum(s.ipr) > 0")
check("broken-canonical-target", "indexation", "high", "D", 3, "per-page")(lambda q: """SELECT url_key, canonical, target_status, reason FROM (SELECT p.url_key, p.canonical_key AS canonical, t.status_code AS target_status,
    CASE WHEN t.status_code IS NULL OR t.status_code <> 200 THEN 'status' WHEN t.noindex THEN 'noindex' WHEN t.canonical_key IS NOT NULL AND t.canonical_key <> t.url_key THEN CASE WHEN t.canonical_key = p.url_key THEN 'loop' ELSE 'chain' END WHEN p.url ILIKE 'https://%' AND t.url ILIKE 'http://%' THEN 'https to http' END AS reason
    FROM p_pages p JOIN p_pages t ON t.url_key = p.canonical_key WHERE p.status_code = 200 AND p.canonical_key <> p.url_key) c WHERE reason IS NOT NULL""")
check("pagination-canonical-to-page-1", "crawlability", "high", "D", 3, "global")(lambda q: f"SELECT url_key, url, canonical_key AS canonical FROM p_pages WHERE status_code = 200 AND (rel_prev OR {paged(q)}) AND canonical_key IS NOT NULL AND canonical_key <> url_key AND NOT {paged(q, 'canonical_key')}")
ALT = lambda q: f"(SELECT p.url_key AS src, h.x.lang AS lang, h.x.href_key AS alt FROM p_pages p, {q.unnest('p.hreflang', 'h')} WHERE p.status_code = 200 AND p.indexable AND h.x.href_key <> p.url_key)"
TEN = lambda q: "list(a.alt ORDER BY a.alt)[1:10]" if q.duck else "slice(sort_array(collect_list(a.alt)), 1, 10)"
check("broken-hreflang-target", "indexation", "high", "D", 3, "per-page")(lambda q: f"SELECT a.src AS url_key, {q.join(TEN(q))} AS broken_alternates, count(*) AS n FROM (SELECT DISTINCT src, alt FROM {ALT(q)} x) a JOIN p_pages t ON t.url_key = a.alt WHERE t.status_code <> 200 OR t.noindex GROUP BY a.src")
check("hreflang-no-return-tag", "indexation", "high", "D", 3, "per-page")(lambda q: f"SELECT a.src AS url_key, {q.join(TEN(q))} AS missing_return_from, count(*) AS n FROM (SELECT DISTINCT src, alt FROM {ALT(q)} x WHERE lower(lang) <> 'x-default') a JOIN p_pages t ON t.url_key = a.alt LEFT JOIN (SELECT DISTINCT src, alt FROM {ALT(q)} y) b ON b.src = a.alt AND b.alt = a.src WHERE t.status_code = 200 AND t.indexable AND b.src IS NULL GROUP BY a.src")
check("entity-internal-link-gap", "crawlability", "low", "N", 3, "per-page", 0.5)(lambda q: "SELECT pp.url_key, cp.url_key AS suggest_link_to, pp.label AS parent_entity, cp.label AS child_entity, e.relation FROM p_entity_edge e JOIN p_page_entity cp ON cp.qid = e.qid JOIN p_page_entity pp ON pp.qid = e.related_qid LEFT JOIN (SELECT DISTINCT source_key, target_key FROM p_links) l ON l.source_key = pp.url_key AND l.target_key = cp.url_key WHERE l.source_key IS NULL AND pp.url_key <> cp.url_key")
check("underlinked-editorial", "merged", "high", "D+G", 3, "per-page", top="impressions")(lambda q: f"SELECT p.url_key, s.impressions, coalesce(b.n, 0) AS in_content_links FROM p_pages p JOIN ({totals(win())}) s ON s.page_key = p.url_key LEFT JOIN (SELECT target_key, count(DISTINCT source_key) AS n FROM p_links WHERE is_internal AND placement = 'body' AND source_key <> target_key GROUP BY target_key) b ON b.target_key = p.url_key WHERE p.indexable AND s.impressions >= 300 AND coalesce(b.n, 0) <= 2 ORDER BY s.impressions DESC, p.url_key LIMIT 40")


@check("anchor-text-incoherent", "merged", "med", "D+G", 3, "per-page")
def anchor_text_incoherent(q):
    """Each distinct anchor of a page is held against its top query; anchors that a large part of the site uses are chrome."""
    return f"""WITH body AS (SELECT target_key, source_key, lower(trim(anchor_text)) AS anchor FROM p_links WHERE is_internal AND placement = 'body' AND source_key <> target_key AND {q.rlike('lower(anchor_text)', '[a-z]')}),
    templated AS (SELECT anchor FROM body GROUP BY anchor HAVING count(DISTINCT source_key) > greatest(20, (SELECT count(*) FROM p_pages WHERE {OK}) * 0.15)),
    anchors AS (SELECT b.target_key, b.anchor, count(*) AS n FROM body b LEFT JOIN templated t ON t.anchor = b.anchor WHERE t.anchor IS NULL GROUP BY b.target_key, b.anchor),
    tq AS ({top_query(NO_BRAND)}),
    said AS (SELECT p.url_key, tq.query AS top_query, tq.impr AS impressions, a.n, CASE WHEN {q.any(q.terms('tq.query'), 'x', q.mentions('a.anchor', 'x'))} THEN 1 ELSE 0 END AS says
        FROM tq JOIN p_pages p ON p.url_key = tq.page_key JOIN anchors a ON a.target_key = p.url_key WHERE p.indexable AND tq.impr >= 100 AND {q.size(q.terms('tq.query'))} > 0)
    SELECT url_key, top_query, impressions, CAST(sum(n) AS BIGINT) AS inbound_in_content_links FROM said GROUP BY url_key, top_query, impressions HAVING sum(n) >= 3 AND max(says) = 0"""


# crawl x search
check("noindex-with-traffic", "indexation", "crit", "D+G", 1, "per-page", top="clicks")(lambda q: f"SELECT p.url_key, s.clicks FROM p_pages p JOIN ({totals(win())}) s ON s.page_key = p.url_key WHERE p.noindex AND s.clicks > 0")
check("orphan-with-impressions", "merged", "high", "D+G", 5, "per-page", top="impressions")(lambda q: f"SELECT p.url_key, s.impressions, s.clicks, p.inlink_count AS inlinks, s.clicks / CAST(nullif((SELECT sum(clicks) FROM p_sa WHERE {win()}), 0) AS DOUBLE) AS traffic_share FROM p_pages p JOIN ({totals(win())}) s ON s.page_key = p.url_key WHERE p.inlink_count = 0 AND p.indexable AND s.impressions > 0")
check("canonical-ignored", "indexation", "high", "D+G", 3, "per-page", top="impressions")(lambda q: f"SELECT p.url_key, p.canonical_key AS declared_canonical, s.impressions, s.clicks FROM p_pages p JOIN ({totals(win())}) s ON s.page_key = p.url_key WHERE p.canonical_key <> p.url_key AND s.impressions >= 50 ORDER BY s.impressions DESC, p.url_key LIMIT 40")
# Fixed value: URL shapes that search engines should not index.
JUNK = "[?&](q|s|search|keyword|orderby|sort_by|filter|variant|pf_|dppref|replytocom)=|/search(-results)?/"
check("indexed-junk-url", "indexation", "high", "D+G", 3, "global", top="impressions")(lambda q: f"SELECT page_key AS url_key, impressions, clicks FROM ({totals(win())}) s WHERE impressions >= 30 AND {q.rlike('lower(page_key)', JUNK)} ORDER BY impressions DESC, page_key LIMIT 40")
check("coverage-not-indexed", "indexation", "high", "G", 5, "per-page")(lambda q: "SELECT url_key, coverage_state FROM p_inspection WHERE coverage_state ILIKE '%not indexed%'")
check("canonical-conflict", "indexation", "high", "G", 3, "per-page")(lambda q: "SELECT url_key, google_canonical, user_canonical FROM p_inspection WHERE google_canonical <> user_canonical")
check("striking-distance", "merged", "high", "G", 5, "per-page", top="impressions")(lambda q: f"SELECT page_key AS url_key, query, position, impressions FROM ({totals(win() + ' AND query IS NOT NULL', 'query, page_key')}) s WHERE position > 10 AND position <= 20 AND impressions >= 20 ORDER BY impressions DESC, query, page_key LIMIT 50")


@check("keyword-cannibalisation", "merged", "high", "G", 5, "per-page", top="impressions")
def keyword_cannibalisation(q):
    """Pages that compete for a query, with the titles of the two largest; distinct titles hint at pages that differ on purpose."""
    by = "impressions DESC, page_key"
    names = f"list(page_key ORDER BY {by})" if q.duck else "transform(sort_array(collect_list(struct(-impressions AS i, page_key AS url))), x -> x.url)"
    shown = f"list(impressions ORDER BY {by})" if q.duck else "transform(sort_array(collect_list(-impressions)), x -> -x)"
    listed = f"{q.join(names)} AS urls, {q.join(q.map(shown, 'v', q.text('v')))} AS url_impressions"
    both = q.size(q.filter("terms_1", "w", f"NOT {q.has('terms_q', 'w')} AND {q.has('terms_2', 'w')}"))
    return f"""WITH s AS (SELECT *, max(impressions) OVER (PARTITION BY query) AS lead FROM ({totals(win() + f' AND query IS NOT NULL AND page_key IS NOT NULL AND {NO_BRAND}', 'query, page_key')}) t WHERE position < 20 AND impressions >= 10),
    r AS (SELECT s.*, p.title, row_number() OVER (PARTITION BY query ORDER BY impressions DESC, page_key) AS place FROM s LEFT JOIN p_pages p ON p.url_key = s.page_key WHERE impressions >= lead * 0.1 OR impressions >= 500),
    g AS (SELECT CAST(NULL AS STRING) AS url_key, query, count(*) AS competing_urls, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, min(position) AS best_position, max(position) AS worst_position, (min(position) + max(position)) / 2 AS position, {listed},
        max(CASE WHEN place = 1 THEN title END) AS title_1, max(CASE WHEN place = 2 THEN title END) AS title_2 FROM r GROUP BY query HAVING count(*) >= 2 AND sum(impressions) >= 50 AND max(position) > 2 ORDER BY impressions DESC, query LIMIT 40),
    w AS (SELECT *, {q.terms('query')} AS terms_q, {q.terms('title_1')} AS terms_1, {q.terms('title_2')} AS terms_2 FROM g)
    SELECT url_key, query, competing_urls, clicks, impressions, best_position, worst_position, position, urls, url_impressions, title_1, title_2, title_1 IS NOT NULL AND title_2 IS NOT NULL AND {both} < 2 AS differentiated FROM w"""


check("ctr-below-expected", "merged", "high", "G", 3, "per-page", top="impressions")(lambda q: f"SELECT * FROM (SELECT page_key AS url_key, position, clicks / CAST(impressions AS DOUBLE) AS ctr, {q.ctr('position')} AS expected_ctr, impressions FROM ({totals(win() + ' AND page_key IS NOT NULL')}) s WHERE position <= 10 AND impressions >= 500) t WHERE ctr < 0.5 * expected_ctr")
check("traffic-decay", "merged", "high", "G", 5, "per-page", top="clicks_lost")(lambda q: f"SELECT page_key AS url_key, prev AS previous_clicks, cur AS current_clicks, prev - cur AS clicks_lost, CAST(floor((1 - cur / CAST(prev AS DOUBLE)) * 100 + 0.5) AS BIGINT) AS drop_percent, prev AS clicks, prev_impr AS impressions, prev_pos AS position FROM ({periods('page_key')}) s WHERE {span(q, 56)} AND prev >= 30 AND cur < 0.6 * prev ORDER BY clicks_lost DESC, page_key LIMIT 40")
check("lost-queries", "merged", "med", "G", 5, "per-page", top="previous_clicks")(lambda q: f"SELECT CAST(NULL AS STRING) AS url_key, query, prev AS previous_clicks, cur AS current_clicks, prev AS clicks, prev_impr AS impressions FROM ({periods('query')}) s WHERE {span(q, 56)} AND prev >= 10 AND cur = 0 ORDER BY prev DESC, query LIMIT 40")
check("position-slipping", "merged", "high", "G", 3, "per-page", top="impressions")(lambda q: f"SELECT CAST(NULL AS STRING) AS url_key, query, prev_pos AS previous_position, cur_pos AS current_position, cur_pos - prev_pos AS slipped_by, cur_impr AS impressions, cur AS clicks, cur_pos AS position FROM ({periods('query')}) s WHERE {span(q, 56)} AND cur_impr >= 100 AND prev_pos <= 10 AND cur_pos - prev_pos >= 3 ORDER BY (cur_pos - prev_pos) * cur_impr DESC, query LIMIT 40")
check("rising-pages", "merged", "low", "G", 2, "per-page", top="clicks_gained")(lambda q: f"SELECT page_key AS url_key, prev AS previous_clicks, cur AS current_clicks, cur - prev AS clicks_gained, cur AS clicks, cur_impr AS impressions, cur_pos AS position FROM ({periods('page_key')}) s WHERE {span(q, 56)} AND prev_rows > 0 AND cur >= 30 AND cur >= 1.5 * prev ORDER BY clicks_gained DESC, page_key LIMIT 25")
check("impressions-rising-clicks-flat", "merged", "high", "G", 3, "per-page", top="impressions")(lambda q: f"SELECT page_key AS url_key, prev_impr AS previous_impressions, cur_impr AS current_impressions, cur_impr - prev_impr AS impressions_change, prev AS previous_clicks, cur AS current_clicks, cur_impr AS impressions, cur AS clicks, cur_pos AS position FROM ({periods('page_key')}) s WHERE {span(q, 56)} AND prev_impr >= 200 AND cur_impr >= 1.3 * prev_impr AND cur <= prev ORDER BY impressions_change DESC, page_key LIMIT 40")
check("index-bloat", "indexation", "med", "D+G", 5, "per-page", top="ipr")(lambda q: f"SELECT p.url_key, p.ipr FROM p_pages p LEFT JOIN (SELECT DISTINCT page_key FROM p_sa WHERE page_key IS NOT NULL AND impressions > 0 AND {win(90)}) s ON s.page_key = p.url_key WHERE {span(q, 90)} AND p.{OK} AND p.indexable AND coalesce(p.click_depth, 999) >= 1 AND s.page_key IS NULL ORDER BY p.ipr DESC, p.url_key LIMIT 100")
check("traffic-to-dead-url", "merged", "high", "D+G", 3, "per-page", top="impressions")(lambda q: f"SELECT p.url_key, p.status_code AS status, s.clicks, s.impressions FROM p_pages p JOIN ({totals(win())}) s ON s.page_key = p.url_key WHERE p.status_code >= 400 AND s.impressions >= 10 ORDER BY s.impressions DESC, p.url_key LIMIT 40")


def query_missing(where: str, text: str, evidence: str = ""):
    return lambda q: f"WITH tq AS ({top_query()}) SELECT p.url_key, tq.query AS top_query, tq.impr AS impressions{evidence} FROM tq JOIN p_pages p ON p.url_key = tq.page_key WHERE p.indexable AND tq.impr >= 100 AND {where} AND {q.size(q.terms('tq.query'))} > 0 AND NOT {q.any(q.terms('tq.query'), 'x', q.mentions(text(q) if callable(text) else text, 'x'))}"


PASSAGES = lambda q: q.join(q.map("p.body_chunks", "c", "concat(coalesce(c.heading, ''), ' ', coalesce(c.text, ''))"))
check("h1-missing-top-query", "merged", "med", "D+G", 3, "per-page")(query_missing("p.h1 IS NOT NULL AND p.h1 <> ''", "p.h1", ", p.h1"))
check("title-missing-top-query", "merged", "high", "D+G", 3, "per-page")(query_missing("p.title IS NOT NULL AND p.title <> ''", "p.title", ", p.title"))
check("body-missing-top-query", "merged", "med", "D+G", 5, "per-page")(query_missing("p.body_chunks IS NOT NULL", lambda q: f"concat(coalesce(p.title, ''), ' ', coalesce(p.h1, ''), ' ', {PASSAGES(q)})"))


@check("rag-answer-gap", "merged", "med", "G+N", 5, "per-page", 0.6)
def rag_answer_gap(q):
    t = q.terms("tq.query")
    one = "concat(coalesce(c.heading, ''), ' ', coalesce(c.text, ''))"
    return f"WITH tq AS ({top_query()}) SELECT p.url_key, tq.query AS top_query, tq.impr AS impressions FROM tq JOIN p_pages p ON p.url_key = tq.page_key WHERE p.indexable AND p.body_chunks IS NOT NULL AND tq.impr >= 200 AND {q.size(t)} >= 2 AND {q.all(t, 'x', q.mentions(PASSAGES(q), 'x'))} AND NOT {q.any('p.body_chunks', 'c', q.all(t, 'x', q.mentions(one, 'x')))}"


# Fixed value: words of informational queries.
INFO = "(^|[^a-z0-9_])(how|what|why|when|which|who|guide|tutorial|best|vs|versus|is|are|does|do|can|should|tips|ideas|examples|meaning|definition|setup|settings)([^a-z0-9_]|$)"


@check("answer-not-front-loaded", "merged", "med", "G+N", 3, "per-page", 0.6)
def answer_not_front_loaded(q):
    t = q.terms("tq.query")
    whole = f"concat(coalesce(p.title, ''), ' ', {PASSAGES(q)})"
    two = "p.body_chunks[1:2]" if q.duck else "slice(p.body_chunks, 1, 2)"
    front = f"substring(concat(coalesce(p.title, ''), ' ', {q.join(q.map(two, 'c', 'concat(coalesce(c.heading, ' + chr(39) * 2 + '), ' + repr(' ') + ', coalesce(c.text, ' + chr(39) * 2 + '))'))}), 1, 1200)"
    return f"WITH tq AS ({top_query()}) SELECT p.url_key, tq.query AS top_query, tq.impr AS impressions FROM tq JOIN p_pages p ON p.url_key = tq.page_key WHERE p.indexable AND p.body_chunks IS NOT NULL AND p.word_count >= 800 AND tq.impr >= 100 AND {q.rlike('lower(tq.query)', INFO)} AND {q.any(t, 'x', q.mentions(whole, 'x'))} AND NOT {q.any(t, 'x', q.mentions(front, 'x'))}"


check("high-ipr-no-traffic", "merged", "med", "D+G", 5, "per-page", top="ipr")(lambda q: f"SELECT p.url_key, p.ipr, p.inlink_count AS inlinks, s.impressions, s.clicks FROM p_pages p JOIN ({totals(win(90))}) s ON s.page_key = p.url_key WHERE {span(q, 90)} AND p.indexable AND p.ipr >= 50 AND coalesce(p.click_depth, 999) >= 1 AND s.clicks = 0 AND s.impressions >= 100 ORDER BY p.ipr DESC, p.url_key LIMIT 50")
check("ghost-pages", "merged", "high", "D+G", 5, "per-page", top="impressions")(lambda q: f"SELECT s.page_key AS url_key, s.clicks, s.impressions FROM ({totals(win() + ' AND page_key IS NOT NULL')}) s LEFT JOIN p_pages p ON p.url_key = s.page_key WHERE p.url_key IS NULL AND s.impressions >= 50 AND (SELECT count(*) FROM p_crawl WHERE urls_crawled > 0 AND (max_pages IS NULL OR urls_crawled < max_pages)) > 0")
check("underlinked-high-demand", "merged", "high", "D+G", 5, "per-page", top="impressions")(lambda q: f"SELECT p.url_key, s.impressions, p.ipr, p.inlink_count AS inlinks FROM p_pages p JOIN ({totals(win())}) s ON s.page_key = p.url_key WHERE p.indexable AND p.ipr < 30 AND p.inlink_count BETWEEN 1 AND 3 AND s.impressions >= 300")
check("backlinks-to-404", "crawlability", "crit", "D", 3, "per-page", top="backlinks")(lambda q: "SELECT url_key, status_code AS status, backlinks, referring_domains FROM p_backlinks WHERE status_code >= 400 AND backlinks > 0")
check("orphan-no-links", "crawlability", "med", "D", 5, "per-page")(lambda q: "SELECT p.url_key, p.inlink_count AS inlinks, coalesce(b.backlinks, 0) AS backlinks FROM p_pages p LEFT JOIN p_backlinks b ON b.url_key = p.url_key WHERE (SELECT count(*) FROM p_backlinks) > 0 AND p.indexable AND p.inlink_count = 0 AND coalesce(b.backlinks, 0) = 0")
check("faceted-spider-trap", "crawlability", "high", "D+G", 5, "global")(lambda q: f"SELECT p.url_key, p.url, length(p.url) - length(replace(p.url, '&', '')) + 1 AS params FROM p_pages p LEFT JOIN (SELECT DISTINCT page_key FROM p_sa WHERE page_key IS NOT NULL AND impressions > 0 AND {win()}) s ON s.page_key = p.url_key WHERE p.indexable AND {q.contains('p.url', repr('?'))} AND {q.contains('p.url', repr('&'))} AND s.page_key IS NULL")
check("soft-404-shell", "indexation", "med", "D+G", 3, "per-page")(lambda q: "SELECT i.url_key, i.page_fetch_state, p.word_count, p.bytes FROM p_inspection i JOIN p_pages p ON p.url_key = i.url_key WHERE i.page_fetch_state ILIKE '%soft%' AND p.status_code = 200")
check("high-yield-cwv-fail", "performance", "med", "D+G", 8, "per-page", top="clicks")(lambda q: f"SELECT c.url_key, s.clicks, c.lcp_ms, c.cls, c.performance FROM p_cwv c JOIN ({totals(win())}) s ON s.page_key = c.url_key WHERE (c.lcp_ms > 2500 OR c.cls > 0.1 OR c.performance < 0.5) AND s.clicks > 0")
HAS_MAP = "(SELECT count(*) FROM p_sitemap) > 0"
check("sitemap-non-indexable", "indexation", "high", "D", 3, "global")(lambda q: f"SELECT p.url_key, p.indexable_reason AS reason, p.status_code AS status FROM p_sitemap m JOIN p_pages p ON p.url_key = m.url_key WHERE {HAS_MAP} AND NOT coalesce(p.indexable, false)")
check("indexable-not-in-sitemap", "indexation", "med", "D", 3, "global")(lambda q: f"SELECT p.url_key FROM p_pages p LEFT JOIN p_sitemap m ON m.url_key = p.url_key WHERE {HAS_MAP} AND p.indexable AND NOT {paged(q, 'p.url_key')} AND m.url_key IS NULL")
check("sitemap-orphan", "crawlability", "low", "D", 3, "per-page")(lambda q: f"SELECT p.url_key, p.inlink_count AS inlinks FROM p_sitemap m JOIN p_pages p ON p.url_key = m.url_key WHERE {HAS_MAP} AND p.indexable AND p.inlink_count = 0")
check("robots-blocked-with-traffic", "crawlability", "high", "D+G", 1, "per-page", top="impressions")(lambda q: f"SELECT p.url_key, s.clicks, s.impressions FROM p_pages p JOIN ({totals(win())}) s ON s.page_key = p.url_key WHERE p.indexable_reason = 'robots-disallowed' AND s.impressions >= 10 ORDER BY s.impressions DESC, p.url_key LIMIT 50")


@check("sitemap-lastmod-untrustworthy", "indexation", "med", "D", 1, "global")
def sitemap_lastmod(q):
    old = "date_diff('day', x.day, a.d)" if q.duck else "datediff(a.d, x.day)"
    same = "IS NOT DISTINCT FROM" if q.duck else "<=>"
    equal = " AND ".join(f"n.{c} {same} o.{c}" for c in ("title", "meta_description", "h1", "word_count", "canonical_key", "schema_types"))
    return f"""WITH a AS (SELECT {D} AS d), dated AS (SELECT count(lastmod) AS n FROM p_sitemap),
    x AS (SELECT lastmod AS day, count(*) AS k FROM p_sitemap WHERE lastmod IS NOT NULL GROUP BY lastmod), shared AS (SELECT max(k) AS k FROM x, dated, a WHERE x.k > 0.9 * dated.n AND {old} < 35),
    late AS (SELECT coalesce(sum(k), 0) AS k FROM x, a WHERE x.day > a.d),
    phantom AS (SELECT count(*) AS k FROM p_snapshots n JOIN p_snapshots o ON n.url_key = o.url_key JOIN p_sitemap m ON m.url_key = n.url_key WHERE n.captured_at = (SELECT max(captured_at) FROM p_snapshots) AND o.captured_at = (SELECT max(captured_at) FROM p_snapshots WHERE captured_at < (SELECT max(captured_at) FROM p_snapshots)) AND m.lastmod > o.captured_at AND {equal})
    SELECT CAST(NULL AS STRING) AS url_key, dated.n AS urls_with_lastmod, CAST(shared.k AS BIGINT) AS shared_stamp, CAST(late.k AS BIGINT) AS future_dates, CAST(phantom.k AS BIGINT) AS phantom_changes FROM dated, shared, late, phantom WHERE dated.n >= 20 AND (shared.k IS NOT NULL OR late.k > 0 OR phantom.k >= 5)"""
