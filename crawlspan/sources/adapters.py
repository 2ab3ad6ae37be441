"""A property made from the driver's tables by integer arithmetic, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..plans.dialect import Dialect

RAW = ("region", "lineitem", "orders", "customer", "nation", "part", "supplier", "events", "documents", "pages")
KEY = "concat('https://site.example/', CASE {k} % 5 WHEN 0 THEN 'blog/post-' WHEN 1 THEN 'product/item-' WHEN 2 THEN 'category/' WHEN 3 THEN 'docs/page/' ELSE 'p-' END, CAST({k} AS STRING), CASE WHEN {k} % 11 = 5 THEN '?variant=red&size=2' ELSE '' END)"


def key(k: str) -> str:
    return KEY.format(k=k)


#: The words of part names, which queries are made of.
LOOKS, KINDS = "blue cold hot large new old red small", "anvil bolt gear gizmo plate ring rod widget"


def chunk(q: Dialect, heading: str, level: str, text: str) -> str:
    return f"{{'heading': {heading}, 'level': {level}, 'text': {text}}}" if q.duck else f"named_struct('heading', {heading}, 'level', {level}, 'text', {text})"


def struct(q: Dialect, **fields: str) -> str:
    return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}" if q.duck else "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def array(q: Dialect, *items: str) -> str:
    return f"[{', '.join(items)}]" if q.duck else f"array({', '.join(items)})"


def definitions(q: Dialect) -> dict[str, str]:
    """Name -> SELECT, each of which may use those before it."""
    n = "(SELECT CAST(floor(max(p_partkey) / 8) AS BIGINT) FROM part)"
    ld = lambda t, rest: "concat('{\"@context\":\"https://schema.org\",\"@type\":\"" + t + "\"" + rest + "}')"
    return {
        "p_sa": f"""SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN l_partkey % 50 = 3 AND l_shipdate < TIMESTAMP '2001-10-07 00:00:00' THEN concat(p_name, ' classic') WHEN l_partkey % 50 = 7 THEN concat('velvet ', CASE l_partkey % 3 WHEN 0 THEN 'cushion' WHEN 1 THEN 'cushion set' ELSE 'curtain' END) WHEN l_partkey % {n} % 17 = 6 THEN concat('best ', p_name) ELSE p_name END AS query, {key(f'(l_partkey % {n})')} AS page_key, o_orderpriority AS device, n_name AS country, 'web' AS search_type,
            CASE WHEN l_partkey % {n} % 15 = 8 THEN 0 ELSE (CAST(l_quantity AS BIGINT) % 7) * 3 END AS clicks, CAST(l_quantity AS BIGINT) * 10 AS impressions, CAST(CASE WHEN l_partkey % 50 = 7 THEN 16 ELSE l_linenumber * 3 - 2 END AS DOUBLE) AS position
            FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
            WHERE NOT (l_partkey % {n} % 15 = 7 AND l_shipdate > TIMESTAMP '2001-06-01 00:00:00')""",
        "p_day": "SELECT max(date) AS day FROM p_sa",
        "p_brand": "SELECT 'blue' AS brand",
        "p_crawl": "SELECT 'c2' AS crawl_id, 'completed' AS status, CAST(100 AS INT) AS urls_crawled, CAST(NULL AS INT) AS max_pages",
        "p_base": f"""SELECT p_partkey AS k, p_name AS name, p_size, {key('p_partkey')} AS url_key,
            CASE WHEN p_partkey % 23 = 7 THEN 404 WHEN p_partkey % 29 = 8 THEN 301 WHEN p_partkey % 31 = 9 THEN 503 WHEN p_partkey % 37 = 10 THEN NULL ELSE 200 END AS status_code,
            CASE WHEN p_partkey % 41 = 11 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
            p_partkey % 19 = 4 AS noindex, CASE WHEN p_partkey % 13 = 6 THEN {key('(p_partkey + 1)')} ELSE {key('p_partkey')} END AS canonical_key
            FROM part WHERE p_partkey < {n} AND p_partkey % 7 <> 3""",
        "p_links": f"""SELECT {key(f'((l_suppkey * 3 + l_linenumber) % {n})')} AS source_key, {key(f'(l_partkey % {n})')} AS target_key,
            concat({key(f'(l_partkey % {n})')}, CASE WHEN l_partkey % 4 = 0 THEN '#top' ELSE '' END) AS target_url,
            CASE WHEN l_partkey % {n} % 15 = 3 THEN concat('see note ', CAST(l_orderkey % 1000 AS STRING)) ELSE CASE l_orderkey % 4 WHEN 0 THEN 'Read more' WHEN 1 THEN p_name WHEN 2 THEN concat('about ', p_brand) ELSE '(0)' END END AS anchor_text, true AS is_internal,
            CASE WHEN l_partkey % {n} % 14 = 9 THEN 'navigation' WHEN l_linenumber % 3 = 0 THEN 'navigation' WHEN l_linenumber % 3 = 1 THEN 'body' ELSE 'footer' END AS placement
            FROM lineitem JOIN part ON p_partkey = l_partkey""",
        "p_inlinks": "SELECT target_key, count(*) AS n FROM p_links WHERE is_internal AND source_key <> target_key GROUP BY target_key",
        "p_pages": f"""SELECT 'c2' AS crawl_id, CASE WHEN k % 43 = 12 THEN replace(url_key, 'https:', 'http:') ELSE url_key END AS url, b.url_key, CAST(b.status_code AS INT) AS status_code, b.content_type,
            CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN '' ELSE 'gzip' END AS content_encoding, CAST(k % 97 * 4000 AS BIGINT) AS bytes, CAST(k % 53 * 40 AS INT) AS response_time_ms, CAST(k % 6 AS INT) AS depth, true AS is_internal,
            b.status_code = 200 AND b.content_type LIKE 'text/html%' AND NOT noindex AND canonical_key = b.url_key AS indexable,
            CASE WHEN b.status_code IS NULL THEN 'robots-disallowed' WHEN b.status_code >= 500 THEN 'http-5xx' WHEN b.status_code >= 400 THEN 'http-4xx' WHEN b.status_code >= 300 THEN 'redirect' WHEN b.content_type NOT LIKE 'text/html%' THEN 'non-html' WHEN noindex THEN 'noindex-meta' WHEN canonical_key <> b.url_key THEN 'canonicalised' END AS indexable_reason,
            noindex, CASE WHEN k % 17 = 1 THEN NULL WHEN k % 17 = 2 THEN ' ' WHEN k % 17 < 6 THEN concat(name, ' guide') ELSE concat(name, ' ', CAST(k AS STRING), CASE WHEN k % 9 = 0 THEN ' with a very long tail that runs on well beyond sixty letters' ELSE '' END) END AS title,
            CAST(CASE WHEN k % 9 = 0 THEN 75 ELSE 20 + k % 30 END AS INT) AS title_length,
            CASE WHEN k % 14 = 0 THEN NULL WHEN k % 14 < 3 THEN 'All about our range' ELSE concat('About ', name, ' number ', CAST(k AS STRING)) END AS meta_description, CAST(k % 200 AS INT) AS meta_description_length,
            CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN 'Welcome to our shop' ELSE name END AS h1, CAST(CASE WHEN k % 8 = 0 THEN 0 WHEN k % 12 = 3 THEN 2 ELSE 1 END AS INT) AS h1_count, CAST(k % 5 AS INT) AS h2_count, CAST(CASE WHEN k % 10 = 2 THEN 1 ELSE 0 END AS INT) AS heading_skips,
            CAST(k * 37 % 3100 AS INT) AS word_count, CASE WHEN k % 15 = 0 THEN NULL ELSE 'en' END AS lang, canonical_key AS canonical_url, canonical_key, CAST(CASE WHEN k % 47 = 5 THEN 2 ELSE 1 END AS INT) AS canonical_count, k % 51 = 3 AS canonical_relative,
            CASE WHEN k % 21 = 4 THEN 'index, NoFollow' WHEN k % 21 = 5 THEN 'max-image-preview: none' ELSE NULL END AS robots, CAST(NULL AS STRING) AS x_robots_tag, CASE WHEN k % 33 = 6 THEN NULL ELSE 'width=device-width' END AS viewport,
            CASE k % 6 WHEN 0 THEN {array(q, ld('Article', ',"headline":"h","datePublished":"2000-05-01","dateModified":"2000-04-01"'), ld('BreadcrumbList', ',"itemListElement":[]'))} WHEN 1 THEN {array(q, ld('Product', ',"name":"n","offers":{"price":"$10"}'))}
                WHEN 2 THEN {array(q, ld('FAQPage', ''), "'{bad,}'")} WHEN 5 THEN NULL ELSE {array(q, ld('BreadcrumbList', ',"itemListElement":[]'))} END AS json_ld, k % 20 = 5 AS has_microdata, false AS has_rdfa,
            CAST(k % 3 AS INT) AS og_tags, CAST(k % 2 AS INT) AS twitter_tags,
            CASE WHEN k % 9 = 1 THEN {array(q, struct(q, lang="'de'", href_key=key('(k + 9)')), struct(q, lang="'x-default'", href_key=key('(k + 1)')))} WHEN k % 9 = 2 THEN {array(q, struct(q, lang="'fr'", href_key=key('(k + 5)')))} ELSE NULL END AS hreflang,
            CASE WHEN k % 16 = 3 THEN {array(q, struct(q, **{"from": key('(k + 2)'), "to": key('(k + 3)'), "status": "CAST(301 AS INT)"}), struct(q, **{"from": key('(k + 3)'), "to": "b.url_key", "status": "CAST(302 AS INT)"}))} WHEN k % 16 = 4 THEN {array(q, struct(q, **{"from": key('(k + 1)'), "to": "b.url_key", "status": "CAST(301 AS INT)"}))} ELSE NULL END AS redirects,
            CAST(k * 7 % 350 AS INT) AS internal_links, CAST(k % 12 AS INT) AS external_links, CAST(k % 10 AS INT) AS image_count, CAST(CASE WHEN k % 10 > 7 THEN 2 ELSE 0 END AS INT) AS images_without_alt, CAST(CASE WHEN k % 10 = 6 THEN 3 ELSE 0 END AS INT) AS images_missing_dimensions,
            false AS rel_next, k % 44 = 7 AS rel_prev, CAST(CASE WHEN k % 26 = 5 THEN 4 ELSE 0 END AS INT) AS mixed_content_count, k % 2 = 0 AS has_hsts, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 3 = 2 END AS has_favicon, CASE WHEN k % 5 = 0 THEN NULL ELSE false END AS has_analytics, CASE WHEN k % 12 = 0 THEN false END AS conditional_304,
            CAST(CASE WHEN k % 9 = 4 THEN 0 WHEN k % 9 = 5 THEN 2 ELSE coalesce(i.n, 0) END AS INT) AS inlink_count, CAST(k * 31 % 101 AS INT) AS ipr, CAST(CASE WHEN k % 18 = 5 THEN NULL ELSE k % 7 END AS INT) AS click_depth, CASE WHEN k % 4 = 1 THEN CAST(k % 9 AS DOUBLE) END AS max_passage_score, name AS max_passage_query, CAST(k AS BIGINT) AS max_passage_impr,
            CASE WHEN k % 13 = 2 THEN NULL WHEN k % 17 = 6 THEN {array(q, chunk(q, "'Intro'", 'CAST(1 AS INT)', "'Welcome to this page.'"), chunk(q, "'More'", 'CAST(2 AS INT)', "'Words that lead nowhere yet.'"), chunk(q, "'All'", 'CAST(2 AS INT)', f"'{LOOKS} {KINDS}'"))}
                WHEN k % 11 = 4 THEN {array(q, chunk(q, "'Intro'", 'CAST(1 AS INT)', "'Welcome to this page.'"), chunk(q, "'Looks'", 'CAST(2 AS INT)', f"'{LOOKS}'"), chunk(q, "'Kinds'", 'CAST(2 AS INT)', f"'{KINDS}'"))}
                WHEN k % 19 = 7 THEN {array(q, *[chunk(q, f"'Part {i}'", 'CAST(2 AS INT)', "repeat('When it comes to value, it is important to note that we delve into a wide range of ideas. ', 4)") for i in range(6)])}
                ELSE {array(q, chunk(q, "'Intro'", 'CAST(1 AS INT)', "'It is a start and this text has well over sixty characters in it for sure.'"), chunk(q, 'name', 'CAST(2 AS INT)', "concat('They say that ', CASE WHEN k % 2 = 0 THEN name ELSE 'nothing' END, ' is worth some sixty characters of running text, more or less.')"), chunk(q, "'More'", 'CAST(k % 4 AS INT)', "concat('Details follow here on ', CASE WHEN k % 3 = 0 THEN name ELSE 'the rest' END, ' with enough words to count as a passage of text.')"))} END AS body_chunks
            FROM p_base b LEFT JOIN p_inlinks i ON i.target_key = b.url_key""",
        "p_inspection": "SELECT url_key, CASE k % 4 WHEN 0 THEN 'Crawled - currently Not Indexed' ELSE 'Submitted and indexed' END AS coverage_state, CASE WHEN k % 10 = 4 THEN 'SOFT_404' ELSE 'SUCCESSFUL' END AS page_fetch_state, url_key AS google_canonical, CASE WHEN k % 15 = 2 THEN 'https://other.example/' WHEN k % 15 = 3 THEN NULL ELSE url_key END AS user_canonical, 'FAIL' AS verdict, CASE WHEN k % 12 = 2 THEN '{\"detectedItems\":[{\"richResultType\":\"Product\",\"items\":[{\"name\":\"a\",\"issues\":[{\"issueMessage\":\"no price\",\"severity\":\"ERROR\"}]},{\"name\":\"b\",\"issues\":[{\"issueMessage\":\"no price\",\"severity\":\"ERROR\"},{\"issueMessage\":\"no image\",\"severity\":\"WARNING\"}]}]}]}' END AS rich_results FROM p_base WHERE k % 2 = 0",
        "p_backlinks": "SELECT url_key, CAST(k % 5 AS INT) AS backlinks, CAST(k % 3 AS INT) AS referring_domains, CAST(status_code AS INT) AS status_code, CAST(CASE WHEN k % 4 = 0 THEN NULL ELSE k % 60 END AS INT) AS trust_flow FROM p_base WHERE k % 3 <> 0",
        "p_cwv": "SELECT url_key, CAST(k % 10 AS DOUBLE) / 10 AS performance, CAST(1500 + k % 30 * 100 AS DOUBLE) AS lcp_ms, CAST(k % 4 AS DOUBLE) / 20 AS cls, CAST(k % 50 AS DOUBLE) AS tbt_ms FROM p_base WHERE k % 2 = 1",
        "p_sitemap": "SELECT url_key, CASE WHEN k % 10 = 0 THEN NULL ELSE DATE '2001-10-20' END AS lastmod FROM p_base WHERE k % 4 <> 1",
        "p_intent": "SELECT DISTINCT lower(name) AS keyword, CASE p_size % 3 WHEN 0 THEN 'informational' WHEN 1 THEN 'transactional' ELSE 'commercial' END AS intent, CAST(1 AS DOUBLE) AS probability FROM (SELECT name, min(p_size) AS p_size FROM p_base GROUP BY name) n",
        "p_page_entity": "SELECT url_key, concat('Q', CAST(k AS STRING)) AS qid, name AS label FROM p_base WHERE k % 3 = 0",
        "p_entity_edge": "SELECT concat('Q', CAST(k AS STRING)) AS qid, concat('Q', CAST(k + 6 AS STRING)) AS related_qid, CASE WHEN k % 2 = 0 THEN 'subclass' ELSE 'part' END AS relation FROM p_base",
        "p_snapshots": """SELECT 'c1' AS crawl_id, DATE '2001-09-01' AS captured_at, url_key, CAST(CASE WHEN k % 23 = 7 THEN 200 ELSE status_code END AS INT) AS status_code, k % 10 <> 4 AS indexable, CASE WHEN k % 6 = 1 THEN 'Old title' ELSE name END AS title, 'm' AS meta_description, name AS h1, url_key AS canonical_key, k % 19 = 5 AS noindex, CAST(1000 + k AS INT) AS word_count, CASE WHEN k % 8 = 0 THEN 'Product' ELSE '' END AS schema_types FROM p_base WHERE k % 12 <> 1
            UNION ALL SELECT 'c2', DATE '2001-10-01', url_key, CAST(status_code AS INT), k % 10 <> 5, name, CASE WHEN k % 9 = 1 THEN 'changed' ELSE 'm' END, CASE WHEN k % 11 = 1 THEN NULL ELSE name END, canonical_key, noindex, CAST(CASE WHEN k % 25 = 2 THEN 100 ELSE 1000 + k END AS INT), CASE WHEN k % 16 = 0 THEN 'Product' ELSE '' END FROM p_base WHERE k % 12 <> 2""",
        "p_keywords": f"SELECT CASE l_linenumber % 3 WHEN 0 THEN 'a.example' WHEN 1 THEN 'b.example' ELSE 'site.example' END AS competitor, concat(p_name, CASE l_partkey % 3 WHEN 0 THEN ' kit' WHEN 1 THEN ' price' ELSE '' END) AS keyword, CAST(l_partkey % 90 * 20 AS BIGINT) AS volume, CAST(l_partkey % 25 + 1 AS INT) AS position, concat('https://', CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'site' END, '.example/', CAST(l_partkey AS STRING)) AS url, CAST(l_partkey % 40 AS DOUBLE) AS etv, CASE WHEN l_partkey % 2 = 0 THEN {array(q, chr(39) + 'video' + chr(39), chr(39) + 'organic' + chr(39))} ELSE {array(q, chr(39) + 'ai_overview' + chr(39))} END AS features FROM (SELECT DISTINCT l_linenumber, l_partkey FROM lineitem ) l JOIN part ON p_partkey = l_partkey",
    }


#: Tables that most queries read: written once, where every executor can read them.
STORED = ("p_sa", "p_day", "p_links", "p_pages")


def register(spark: SparkSession, sf_dir: str, at: str) -> None:
    """Temporary views of the raw tables and of the property made from them; the tables that most queries read are stored below at."""
    from ..plans.dialect import SPARK

    for t in RAW:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in definitions(SPARK).items():
        made = spark.sql(sql)
        if name in STORED:
            made.write.mode("overwrite").parquet(f"{at}/{name}")
            made = spark.read.parquet(f"{at}/{name}")
        made.createOrReplaceTempView(name)


def stamp(spark: SparkSession, sf_dir: str) -> str:
    """Changes when a raw table's files do."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for t in RAW:
        p = path(f"{sf_dir}/{t}.parquet")
        fs = p.getFileSystem(conf)
        out += [f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(p)] if fs.exists(p) else [t]
    return "; ".join(out)


def with_tables(sql: str) -> str:
    """DuckDB SQL: the property's tables that ``sql`` needs, as CTEs before it."""
    from ..plans.dialect import DUCK

    defs = definitions(DUCK)
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in defs:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(defs[name])
    ctes = ", ".join(f"{n} AS ({d})" for n, d in defs.items() if n in need)
    return f"WITH {ctes} SELECT * FROM ({sql}) AS result" if ctes else sql
