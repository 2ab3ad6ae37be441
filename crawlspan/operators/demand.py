"""From queries to pages that don't exist yet: opportunities, topic gaps, keyword lists, market size, features.

Demand, coverage and ranking are joins and aggregates. Clustering is greedy in order of demand, so it is
sequential by definition; it runs over what the subtraction leaves, split first by connected vocabulary
(texts that share no token can never be put together), one task per such block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import path_of
from ..plans.dialect import STOP_WORDS
from .checks import WPOS, win
from .graph import cut

# Fixed value: worth of an intent.
INTENT = {"transactional": 1.0, "commercial": 0.8, "informational": 0.3, "navigational": 0.1}
INTENT_ELSE = 0.5
#: Words that opportunities pass over, besides those of queries.
EXTRA_STOP = ("my", "i", "it")


def tokens(s: Column, stop: tuple[str, ...] = (*STOP_WORDS, *EXTRA_STOP), least: int = 2) -> Column:
    t = F.split(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9 ]+", " "), " +")
    return F.array_distinct(F.filter(t, lambda x: (F.length(x) >= least) & ~x.isin(*stop) if stop else F.length(x) >= least))


def loose_tokens(s: Column) -> Column:
    return tokens(s, (), 2)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def greedy(rows: list[tuple[str, frozenset]], at_least: float, best_match: bool = False, grow: bool = True) -> list[int]:
    """Cluster numbers of rows taken in order: the first cluster (or the best) that is similar enough, else a new one."""
    clusters: list[set] = []
    out = []
    for _, toks in rows:
        score = [len(toks & c) / len(toks | c) if toks | c else 0.0 for c in clusters]
        ok = [i for i, x in enumerate(score) if x >= at_least]
        i = (max(ok, key=lambda i: (score[i], -i)) if best_match else ok[0]) if ok else len(clusters)
        if i == len(clusters):
            clusters.append(set(toks))
        elif grow:
            clusters[i] |= toks
        out.append(i)
    return out


def blocks(df: DataFrame, id_: str, toks: str) -> DataFrame:
    """df + block: the smallest id that shared tokens connect a row to."""
    label = cut(df.select(F.col(id_).alias("id"), F.explode(toks).alias("t")).withColumn("block", F.col("id")))
    while True:
        low = label.withColumn("block", F.min("block").over(Window.partitionBy("t")))
        low = cut(low.withColumn("block", F.min("block").over(Window.partitionBy("id"))))
        if label.alias("a").join(low.alias("b"), ["id", "t"]).where("a.block <> b.block").isEmpty():
            break
        label = low
    return df.join(low.select(F.col("id").alias(id_), "block").distinct(), id_)


def cluster(df: DataFrame, text: str, toks: str, weight: str, at_least: float, best_match: bool = False) -> DataFrame:
    """df + head: each row's cluster by its first member. Order: weight, largest first, then text."""
    plain = df.withColumn("_w", F.col(weight).cast("double"))
    keyed = blocks(plain, text, toks)
    schema = f"{text} string, head string"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_w", text], ascending=[False, True], kind="stable")
        n = greedy([(q, frozenset(t)) for q, t in zip(g[text], g[toks], strict=True)], at_least, best_match)
        first: dict[int, str] = {}
        for q, i in zip(g[text], n, strict=True):
            first.setdefault(i, q)
        return pd.DataFrame({text: g[text].to_numpy(), "head": [first[i] for i in n]})

    return df.join(keyed.select("block", text, toks, "_w").groupBy("block").applyInPandas(run, schema), text)


def page_vocabulary(spark) -> DataFrame:
    words = F.concat_ws(" ", "title", "h1", F.regexp_replace(path_of(F.col("url")), "[-_/]+", " "))
    return spark.table("p_pages").where("status_code = 200").select("url_key", F.explode(tokens(words)).alias("t"))


def coverage(queries: DataFrame, spark) -> DataFrame:
    """query -> cover, nearest: the best share of its tokens on one page, and that page."""
    q = queries.select("query", F.size("toks").alias("n"), F.explode("toks").alias("t"))
    hit = q.join(page_vocabulary(spark), "t").groupBy("query", "n", "url_key").agg((F.count(F.lit(1)) / F.col("n")).alias("cover"))
    return hit.groupBy("query").agg(F.max("cover").alias("cover"), F.min_by("url_key", F.struct(-F.col("cover"), "url_key")).alias("nearest"))


def opportunities(spark, least: int = 50, at_least: float = 0.5, top: int = 50) -> DataFrame:
    """New pages that demand asks for: queries that rank on no first page, no contender owns, and no page covers."""
    qp = spark.sql(f"SELECT query, page_key, sum(impressions) AS impr, sum(clicks) AS clicks, {WPOS} AS pos FROM p_sa WHERE query IS NOT NULL AND page_key IS NOT NULL AND {win()} GROUP BY query, page_key")
    q = qp.groupBy("query").agg(F.sum("impr").alias("impr"), F.sum("clicks").alias("clicks"), F.min("pos").alias("best"), F.max(F.struct("impr", F.col("pos").alias("p"))).alias("top"))
    q = q.where((F.col("impr") >= least) & (F.col("best") > 10) & ~((F.col("top.impr") > 0.8 * F.col("impr")) & (F.col("top.p") <= 15)))
    q = q.withColumn("toks", tokens(F.col("query"))).where(F.size("toks") > 0)
    left = cut(q.join(coverage(q, spark), "query", "left").where(F.coalesce("cover", F.lit(0.0)) < 0.7))
    c = cluster(left, "query", "toks", "impr", at_least)
    c = c.groupBy("head").agg(F.sum("impr").alias("impressions"), F.sum("clicks").alias("clicks"), F.floor(F.min("best") * 10 + 0.5).alias("best10"), F.slice(F.sort_array(F.collect_list("query")), 1, 20).alias("queries"), F.max(F.when(F.col("query") == F.col("head"), F.col("nearest"))).alias("nearest_page"))
    c = c.join(spark.table("p_intent").select(F.col("keyword"), "intent"), F.lower("head") == F.col("keyword"), "left")
    worth = F.coalesce(F.create_map(*[F.lit(x) for kv in INTENT.items() for x in kv])[F.col("intent")], F.lit(INTENT_ELSE))
    return c.select("head", "queries", "impressions", "clicks", (F.col("best10") / 10).alias("best_position"), "intent", F.floor(F.col("impressions") * worth + 0.5).cast("long").alias("score"), "nearest_page").orderBy(F.desc("score"), "head").limit(top)


def topic_gaps(spark, own: str = "site.example", top: int = 15) -> DataFrame:
    """Topics that competitors rank for and the property neither ranks for nor covers."""
    k = spark.table("p_keywords").where(F.col("competitor") != own).groupBy(F.lower("keyword").alias("query")).agg(F.max("volume").alias("volume"), F.collect_set("competitor").alias("by"), F.min("url").alias("example"), F.min_by("competitor", F.struct("position", "competitor")).alias("owner"))
    k = k.join(spark.sql("SELECT DISTINCT lower(query) AS query FROM p_sa WHERE query IS NOT NULL"), "query", "left_anti").withColumn("toks", tokens(F.col("query"))).where(F.size("toks") > 0)
    left = cut(k.join(coverage(k, spark), "query", "left").where(F.coalesce("cover", F.lit(0.0)) < 0.7))
    c = cluster(left, "query", "toks", "volume", 0.5).groupBy("head").agg(F.sum("volume").alias("volume"), F.size(F.array_distinct(F.flatten(F.collect_list("by")))).alias("competitors"), F.count(F.lit(1)).alias("keywords"), F.max(F.when(F.col("query") == F.col("head"), F.col("owner"))).alias("owner"), F.max(F.when(F.col("query") == F.col("head"), F.col("example"))).alias("example_url"))
    return c.withColumn("score", F.col("volume") * F.col("competitors")).orderBy(F.desc("score"), "head").limit(top)


def keyword_list(spark, keywords: DataFrame) -> DataFrame:
    """(keyword) -> its best page of 90 days, cluster and verdict: own up to position 3, weak beyond, absent without a page."""
    best = spark.sql(f"SELECT lower(query) AS keyword, page_key, sum(clicks) AS clicks, sum(impressions) AS impr, {WPOS} AS pos FROM p_sa WHERE query IS NOT NULL AND page_key IS NOT NULL AND {win(90)} GROUP BY lower(query), page_key")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("impr"), "page_key"))).where("n = 1").drop("n")
    k = keywords.select(F.lower("keyword").alias("keyword")).distinct().join(best, "keyword", "left").withColumn("toks", loose_tokens(F.col("keyword")))
    k = cut(k)
    placed = k.where("page_key IS NOT NULL").withColumn("cluster", F.col("page_key"))
    words = placed.groupBy("cluster").agg(F.array_distinct(F.flatten(F.collect_list("toks"))).alias("words"))
    orphan = k.where("page_key IS NULL")
    # only clusters that share a token can be similar
    near = orphan.select("keyword", "toks", F.explode("toks").alias("t")).join(words.select("cluster", "words", F.explode("words").alias("t")), "t").select("keyword", "toks", "cluster", "words").distinct()
    near = near.withColumn("j", jaccard(F.col("toks"), F.col("words"))).where("j >= 0.4").groupBy("keyword").agg(F.min_by("cluster", F.struct(-F.col("j"), "cluster")).alias("cluster"))
    joined = orphan.join(near, "keyword")
    alone = cluster(orphan.join(near, "keyword", "left_anti").withColumn("one", F.lit(1)), "keyword", "toks", "one", 0.4).withColumnRenamed("head", "cluster")
    out = placed.unionByName(joined, allowMissingColumns=True).unionByName(alone.drop("one"), allowMissingColumns=True)
    return out.select("keyword", "cluster", "page_key", F.col("impr").cast("long").alias("impressions"), F.col("pos").alias("position"), F.when(F.col("page_key").isNull(), "absent").when(F.col("pos") <= 3, "own").otherwise("weak").alias("verdict"))


def market_size(spark) -> DataFrame:
    """Share of voice of each domain over the keywords' estimated traffic, in percent."""
    k = spark.table("p_keywords").groupBy("competitor").agg(F.sum("etv").alias("etv"), F.countDistinct(F.lower("keyword")).alias("keywords"))
    total = k.agg(F.sum("etv").alias("total"))
    return k.join(F.broadcast(total)).select(F.col("competitor").alias("domain"), "keywords", "etv", (F.col("etv") * 100 / F.nullif(F.col("total"), F.lit(0.0))).alias("share_of_voice"))


def market_topics(spark, top: int = 15) -> DataFrame:
    k = spark.table("p_keywords").groupBy(F.lower("keyword").alias("query")).agg(F.max("volume").alias("volume")).withColumn("toks", loose_tokens(F.col("query"))).where(F.size("toks") > 0)
    c = cluster(k, "query", "toks", "volume", 0.35, best_match=True).groupBy("head").agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("members"))
    return c.where("members >= 2 OR volume >= 500").orderBy(F.desc("volume"), "head").limit(top)


# Fixed value: feature types that say nothing.
NOISE = ("organic", "paid", "related_searches", "people_also_search", "images")


def serp_footprint(spark, own: str = "site.example", top: int = 12) -> DataFrame:
    """Features on the result pages of own keywords, by volume, split by whether the property is on page one."""
    k = spark.table("p_keywords").where(F.col("competitor") == own).groupBy(F.lower("keyword").alias("keyword")).agg(F.max("volume").alias("volume"), F.min("position").alias("position"), F.first("features").alias("features"))
    n = k.agg(F.count(F.lit(1)).alias("all_keywords"))
    f = k.select("*", F.explode(F.array_distinct("features")).alias("feature")).where(~F.col("feature").isin(*NOISE))
    f = f.groupBy("feature").agg(F.count(F.lit(1)).alias("keywords"), F.sum("volume").alias("volume"), F.count_if(F.col("position") <= 10).alias("page_one"))
    return f.join(F.broadcast(n)).select("feature", "keywords", "volume", "page_one", (F.col("keywords") / F.col("all_keywords")).alias("share")).orderBy(F.desc("volume"), "feature").limit(top)
