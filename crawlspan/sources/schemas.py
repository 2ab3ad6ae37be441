"""Tables of one property, keyed on a normalised URL. Names and types of every column the operators read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "sa": "date DATE, query STRING, page_key STRING, device STRING, country STRING, search_type STRING, clicks BIGINT, impressions BIGINT, position DOUBLE",
    "crawl": "crawl_id STRING, status STRING, urls_crawled INT, max_pages INT",
    "pages": """crawl_id STRING, url STRING, url_key STRING, status_code INT, content_type STRING, content_encoding STRING, bytes BIGINT, response_time_ms INT, depth INT, is_internal BOOLEAN,
        indexable BOOLEAN, indexable_reason STRING, noindex BOOLEAN, title STRING, title_length INT, meta_description STRING, meta_description_length INT, h1 STRING, h1_count INT, h2_count INT, heading_skips INT,
        word_count INT, lang STRING, canonical_url STRING, canonical_key STRING, canonical_count INT, canonical_relative BOOLEAN, robots STRING, x_robots_tag STRING, viewport STRING,
        json_ld ARRAY<STRING>, has_microdata BOOLEAN, has_rdfa BOOLEAN, og_tags INT, twitter_tags INT, hreflang ARRAY<STRUCT<lang: STRING, href_key: STRING>>, redirects ARRAY<STRUCT<`from`: STRING, `to`: STRING, status: INT>>,
        internal_links INT, external_links INT, image_count INT, images_without_alt INT, images_missing_dimensions INT, rel_next BOOLEAN, rel_prev BOOLEAN, mixed_content_count INT, has_hsts BOOLEAN,
        has_favicon BOOLEAN, has_analytics BOOLEAN, conditional_304 BOOLEAN, inlink_count INT, ipr INT, click_depth INT, max_passage_score DOUBLE, max_passage_query STRING, max_passage_impr BIGINT,
        body_chunks ARRAY<STRUCT<heading: STRING, level: INT, text: STRING>>""",
    "links": "source_key STRING, target_key STRING, target_url STRING, anchor_text STRING, is_internal BOOLEAN, placement STRING",
    "inspection": "url_key STRING, coverage_state STRING, page_fetch_state STRING, google_canonical STRING, user_canonical STRING, verdict STRING, rich_results STRING",
    "backlinks": "url_key STRING, backlinks INT, referring_domains INT, status_code INT, trust_flow INT",
    "cwv": "url_key STRING, performance DOUBLE, lcp_ms DOUBLE, cls DOUBLE, tbt_ms DOUBLE",
    "sitemap": "url_key STRING, lastmod DATE",
    "intent": "keyword STRING, intent STRING, probability DOUBLE",
    "page_entity": "url_key STRING, qid STRING, label STRING",
    "entity_edge": "qid STRING, related_qid STRING, relation STRING",
    "snapshots": "crawl_id STRING, captured_at DATE, url_key STRING, status_code INT, indexable BOOLEAN, title STRING, meta_description STRING, h1 STRING, canonical_key STRING, noindex BOOLEAN, word_count INT, schema_types STRING",
    "keywords": "competitor STRING, keyword STRING, volume BIGINT, position INT, url STRING, etv DOUBLE, features ARRAY<STRING>",
}


class Property:
    """The tables of one property as temporary views; missing tables are empty, missing columns null. Checks on rivalry of pages and on anchors pass over queries with the brand."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], brand: str | None = None):
        self.spark, self.brand = spark, brand
        self.tables = {}
        for name, schema in TABLES.items():
            want = spark.createDataFrame([], schema).schema
            df = tables.get(name)
            if df is None:
                df = spark.createDataFrame([], want)
            else:
                df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
            self.tables[name] = df
            df.createOrReplaceTempView("p_" + name)
        spark.sql("SELECT max(date) AS day FROM p_sa").createOrReplaceTempView("p_day")
        # letters and digits only, as queries are matched by whole words
        name = re.sub("[^a-z0-9]", "", (brand or "").lower())
        spark.createDataFrame([(name or None,)], "brand string").createOrReplaceTempView("p_brand")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)
