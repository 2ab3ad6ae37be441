"""Generated fixes: redirects for dead pages, flattened chains, pages to link from, markup stubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import path_of
from .demand import loose_tokens

LEAST_OVERLAP = 0.34


def redirect_targets(spark) -> DataFrame:
    """Dead pages -> the live page whose path shares most tokens, in three server syntaxes."""
    toks = lambda c: loose_tokens(F.regexp_replace(path_of(F.col(c)), "[-_/.]+", " "))
    p = spark.table("p_pages").select("url_key", "status_code", "indexable", toks("url_key").alias("toks"))
    dead = p.where("status_code >= 400 AND status_code NOT IN (429, 503)").select(F.col("url_key").alias("dead"), F.col("toks").alias("a"), F.explode("toks").alias("t"))
    live = p.where("indexable").select(F.col("url_key").alias("live"), F.col("toks").alias("b"), F.explode("toks").alias("t"))
    shared = dead.join(live, "t").groupBy("dead", "live", F.size("a").alias("n"), F.size("b").alias("m")).agg(F.count(F.lit(1)).alias("k"))
    shared = shared.withColumn("overlap", F.col("k") / F.greatest("n", "m")).where(F.col("overlap") >= LEAST_OVERLAP)
    best = shared.groupBy("dead").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "live")).alias("b")).select("dead", F.col("b.live").alias("live"), (-F.col("b.o")).alias("overlap"))
    a, b = path_of(F.col("dead")), F.col("live")
    return best.select("dead", "live", "overlap", F.concat(F.lit("Redirect 301 "), a, F.lit(" "), b).alias("apache"), F.concat(F.lit("location = "), a, F.lit(" { return 301 "), b, F.lit("; }")).alias("nginx"), F.to_json(F.struct(a.alias("source"), b.alias("destination"), F.lit(True).alias("permanent"))).alias("json"))


def flat_chains(spark) -> DataFrame:
    """Redirect chains of two hops or more -> first and last URL."""
    return spark.table("p_pages").where(F.size("redirects") >= 2).select("url_key", F.col("redirects")[0]["from"].alias("from"), F.element_at("redirects", -1)["to"].alias("to"), F.size("redirects").alias("hops"))


def link_donors(spark, top: int = 5) -> DataFrame:
    """For indexable pages with no inlinks: pages that don't link to them yet, by shared title words, then rank."""
    p = spark.table("p_pages").where("indexable AND content_type LIKE '%text/html%'").select("url_key", "ipr", "inlink_count", loose_tokens(F.col("title")).alias("toks"))
    need = p.where("inlink_count = 0").select(F.col("url_key").alias("target"), F.explode("toks").alias("t"))
    give = p.select(F.col("url_key").alias("donor"), "ipr", F.explode("toks").alias("t"))
    pair = need.join(give, "t").where("target <> donor").groupBy("target", "donor", "ipr").agg(F.count(F.lit(1)).alias("shared"))
    linked = spark.table("p_links").select(F.col("source_key").alias("donor"), F.col("target_key").alias("target")).distinct()
    pair = pair.join(linked, ["donor", "target"], "left_anti")
    return pair.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("shared"), F.desc("ipr"), "donor"))).where(F.col("place") <= top)


def markup_stubs(spark) -> DataFrame:
    """JSON-LD to start from, of a type that the path suggests."""
    path = F.lower(path_of(F.col("url_key")))
    kind = F.when(path.rlike("/(blog|news|article)s?/"), "BlogPosting").when(path.rlike("/(product|item|shop)s?/"), "Product").when(path.rlike("/(faq|help)/"), "FAQPage").otherwise("WebPage")
    body = F.struct(F.lit("https://schema.org").alias("@context"), kind.alias("@type"), F.coalesce("title", "h1").alias("name"), F.col("url_key").alias("url"), F.col("meta_description").alias("description"))
    return spark.table("p_pages").where("indexable AND json_ld IS NULL").select("url_key", kind.alias("type"), F.to_json(body).alias("json_ld"))
