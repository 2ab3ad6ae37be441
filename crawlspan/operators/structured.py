"""Checks over structured data and prose, where rows need recursive JSON or text statistics."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonld
from .checks import CHECKS, HTML, Check, D, span, top_query, win
from .graph import cut
from ..plans.dialect import SPARK

FRAMES: dict = {}


def frame(id: str, category: str, severity: str, labels: str, effort: float, fix: str, certainty: float = 1.0, top: str | None = None):
    """Register a check that is built with the DataFrame API from a session whose property views are registered."""

    def add(f):
        CHECKS[id] = Check(id, category, severity, labels, certainty, effort, fix, None, top)
        FRAMES[id] = f
        return f

    return add


def build(id: str, spark) -> DataFrame:
    c = CHECKS[id]
    return FRAMES[id](spark) if c.sql is None else spark.sql(c.sql(SPARK))


def found_issues(kinds: tuple[str, ...]):
    def f(spark):
        p = spark.table("p_pages").where("status_code = 200 AND json_ld IS NOT NULL").select("url_key", jsonld.issues("json_ld").alias("all"))
        hit = F.filter("all", lambda i: i["kind"].isin(*kinds))
        return p.select("url_key", F.transform(hit, lambda i: F.concat_ws(": ", i["type"], i["detail"])).alias("issues")).where(F.size("issues") > 0)

    return f


frame("invalid-schema", "schema", "high", "D", 3, "per-page")(found_issues(("parse", "context", "type")))
frame("missing-required-fields", "schema", "med", "D", 3, "per-page")(found_issues(("required",)))
frame("schema-value-errors", "schema", "med", "D", 1, "per-page")(found_issues(("value",)))
frame("forbidden-schema", "schema", "high", "D+N", 1, "per-page", 0.7)(found_issues(("forbidden",)))


def typed(spark, where: str = "status_code = 200") -> DataFrame:
    return spark.table("p_pages").where(f"{where} AND json_ld IS NOT NULL").select("url_key", "click_depth", F.explode(jsonld.nodes("json_ld")).alias("n")).select("url_key", "click_depth", "n.type", "n.json")


@frame("homepage-missing-org-schema", "schema", "med", "D", 3, "global")
def homepage_missing_org(spark):
    home = spark.table("p_pages").where("status_code = 200").orderBy(F.when(F.col("depth") == 0, 0).otherwise(1), F.desc("inlink_count"), "url_key").limit(1)
    types = home.select("url_key", F.array_distinct(F.transform(jsonld.nodes(F.coalesce("json_ld", F.array().cast("array<string>"))), lambda n: n["type"])).alias("found"))
    return types.where(~F.arrays_overlap("found", F.array(*map(F.lit, ("Organization", "LocalBusiness", "Corporation", "OnlineStore", "WebSite")))) | (F.size("found") == 0))


@frame("breadcrumb-schema-inconsistent", "schema", "low", "D", 3, "per-page")
def breadcrumb_inconsistent(spark):
    own = typed(spark, "indexable").where("type = 'BreadcrumbList'").select("url_key").distinct().withColumn("has", F.lit(True))
    pages = spark.table("p_pages").where("indexable").select("url_key", "click_depth").join(own, "url_key", "left")
    stats = pages.agg((F.count("has") / F.count(F.lit(1))).alias("share"))
    return pages.where("has IS NULL AND click_depth >= 2").join(F.broadcast(stats.where("share >= 0.4"))).select("url_key")


ITEMS = "detectedItems array<struct<richResultType:string,items:array<struct<name:string,issues:array<struct<issueMessage:string,severity:string>>>>>>"


@frame("rich-result-issues", "schema", "med", "D+G", 3, "per-page")
def rich_result_issues(spark):
    t = spark.table("p_inspection").where("rich_results IS NOT NULL").select("url_key", "verdict", F.explode(F.from_json("rich_results", ITEMS)["detectedItems"]).alias("d"))
    t = t.select("url_key", "verdict", "d.richResultType", F.posexplode("d.items").alias("at", "i")).select("url_key", "verdict", "richResultType", "at", "i.name", F.explode("i.issues").alias("x"))
    t = t.groupBy("url_key", "verdict", "richResultType", "x.severity", "x.issueMessage").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "at").alias("sample"))
    return t.groupBy("url_key", "verdict").agg(F.sort_array(F.collect_list(F.concat_ws(" | ", "richResultType", "severity", "issueMessage", F.col("n").cast("string"), "sample"))).alias("issues"))


@frame("intent-vs-pagetype-mismatch", "merged", "med", "G+N", 8, "per-page", 0.7)
def intent_mismatch(spark):
    tq = spark.sql(top_query()).withColumn("keyword", F.lower("query")).join(spark.table("p_intent"), "keyword")
    kinds = typed(spark, "indexable").groupBy("url_key").agg(F.collect_set("type").alias("types"))
    sells = F.exists("types", lambda t: t.isin("Product", "Offer"))
    tells = F.exists("types", lambda t: t.isin("Article", "BlogPosting", "NewsArticle"))
    what = F.when(sells & (F.col("intent") == "informational"), "product page for an informational query").when(tells & (F.col("intent") == "transactional"), "article for a transactional query")
    return tq.join(kinds, tq.page_key == kinds.url_key).select("url_key", F.col("query").alias("top_query"), F.col("intent").alias("query_intent"), what.alias("mismatch")).where("mismatch IS NOT NULL")


@frame("article-date-illogical", "schema", "med", "D", 1, "per-page")
def article_dates(spark):
    a = typed(spark).where(F.col("type").rlike("(?i)article|blogposting")).select("url_key", F.get_json_object("json", "$.datePublished").alias("date_published"), F.get_json_object("json", "$.dateModified").alias("date_modified"))
    a = a.where(F.try_to_timestamp("date_modified") < F.try_to_timestamp("date_published"))
    return a.groupBy("url_key").agg(F.min(F.struct("date_published", "date_modified")).alias("d")).select("url_key", "d.*")


@frame("article-no-author", "schema", "low", "D", 1, "per-page")
def article_no_author(spark):
    a = typed(spark, "status_code = 200 AND indexable").where(F.lower("type").isin("article", "blogposting", "newsarticle", "techarticle", "scholarlyarticle"))
    return a.where(~jsonld.named_author("json")).groupBy("url_key").agg(F.min("type").alias("schema_type"))


@frame("stale-content", "merged", "med", "D+G", 5, "per-page", top="clicks")
def stale_content(spark):
    year = f"(date <= {D} - INTERVAL 365 DAY)"
    s = spark.sql(f"""SELECT page_key AS url_key, sum(CASE WHEN {win(90)} THEN clicks ELSE 0 END) AS c, sum(CASE WHEN {win(90)} THEN impressions ELSE 0 END) AS i, count(CASE WHEN {win(90)} THEN 1 END) AS n,
        sum(CASE WHEN {win(455, 365)} THEN clicks ELSE 0 END) AS pc, sum(CASE WHEN {win(455, 365)} THEN impressions ELSE 0 END) AS pi FROM p_sa WHERE page_key IS NOT NULL AND {span(SPARK, 455)} AND ({win(90)} OR {year}) GROUP BY page_key""")
    s = s.where("n > 0 AND pc >= 50 AND c < 0.75 * pc AND i < 0.85 * pi").join(spark.table("p_pages").where("indexable").select("url_key", "json_ld"), "url_key")
    s = s.orderBy(F.desc(F.col("pc") - F.col("c")), "url_key").limit(40).select("url_key", jsonld.newest_date("json_ld").alias("date_modified"), "c", "i", "pc", "pi")
    d = spark.sql("SELECT max(date) AS d FROM p_sa")
    s = s.join(F.broadcast(d)).where(F.datediff("d", F.try_to_date("date_modified")) >= 365)
    return s.select("url_key", "date_modified", F.col("pc").alias("clicks_last_year"), F.col("c").alias("clicks_now"), F.col("pi").alias("impressions_last_year"), F.col("i").alias("impressions_now"), (F.col("pc") - F.col("c")).alias("clicks"), F.col("pi").alias("impressions"))


# Stock phrases of generic prose.
PHRASES = (
    "in today's fast-paced world", "in today's digital age", "it's important to note", "it is important to note", "in conclusion", "harness the power", "unlock the potential", "look no further",
    "in the realm of", "navigate the complexities", "a testament to", "plays a crucial role", "a wide range of", "when it comes to", "at the end of the day", "whether you're a", "let's dive",
    "dive into the world of", "elevate your", "game-changer", "game changer", "cutting-edge", "ever-evolving", "treasure trove", "rich tapestry", "delve", "delving", "seamlessly", "revolutionize", "revolutionise", "unleash",
)


def prose(texts: list[str]) -> dict | None:
    """Signals of one page: distinct phrases, their density, evenness of sentences, repeated section openings."""
    body = " ".join(texts).lower().replace("’", "'")
    n = len(body.split())
    if n < 250:
        return None
    hits = Counter({p: k for p in PHRASES if (k := sum(1 for _ in re.finditer(f"(?={re.escape(p)})", body)))})
    lengths = [k for s in re.split(r"[.!?]+\s", body) if 5 <= (k := len(s.split())) <= 60]
    cv = None
    if len(lengths) >= 12:
        mean = sum(lengths) / len(lengths)
        cv = math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)) / mean
    opens = Counter(tuple(w) for t in texts if len(w := [x for x in re.sub(r"[^a-z\s]", " ", t.lower()).split() if len(x) > 1][:3]) == 3)
    opener, k = min(opens.items(), key=lambda x: (-x[1], x[0]), default=((), 0))
    k = k if len(texts) >= 5 else 0
    density = hits.total() / n * 1000
    lexical, even, same = len(hits) >= 3 and density >= 2.5, cv is not None and cv < 0.28, k >= 3
    return {"slop_phrases": [p for p, _ in sorted(hits.items(), key=lambda x: (-x[1], x[0]))[:6]], "lex_density": round(density, 1), "sentence_cv": None if cv is None else round(cv, 2), "repeated_opener": " ".join(opener) if same else None,
            "sentences": len(lengths), "signals": lexical + even + same, "lexical": lexical, "score": density + 3 * even + 2 * same}


def at_rank(values: DataFrame, share: float, parts: int = 64) -> DataFrame:
    """The value (one column) at place floor(share * n) in order, the last at most. Values are sorted in ranges, of which only one is looked into."""
    (c,) = values.columns
    ranged = cut(values.repartitionByRange(parts, c).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())
    n = sum(k for _, k in sizes)
    at = max(0, min(n - 1, int(n * share)))
    for part, k in sizes:
        if at < k:
            return ranged.where(F.col("part") == part).orderBy(c).offset(at).limit(1).select(c)
        at -= k
    return ranged.select(c).limit(0)


@frame("ai-slop-signals", "content", "low", "N", 5, "per-page", 0.5, top="score")
def slop(spark):
    schema = "url_key string, slop_phrases array<string>, lex_density double, sentence_cv double, repeated_opener string, sentences int, signals int, lexical boolean, score double"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [{"url_key": u, **m} for u, t in zip(b["url_key"], b["texts"], strict=True) if (m := prose([x for x in t if x]))]
            yield pd.DataFrame(rows, columns=names)

    p = spark.table("p_pages").where(f"status_code = 200 AND indexable AND {HTML} AND word_count >= 300 AND body_chunks IS NOT NULL")
    m = p.select("url_key", F.transform("body_chunks", lambda c: c["text"]).alias("texts")).mapInPandas(run, schema).where("signals > 0")
    m = cut(m)
    return m.join(F.broadcast(at_rank(m.select(F.col("score").alias("p90")), 0.9))).where("signals >= 2 AND lexical AND score >= p90").orderBy(F.desc("score"), "url_key").limit(30).drop("p90", "lexical", "signals")
