"""Passages, rank history, routing of what to read, and the flow of the to-do ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import Dialect

# Lower bounds of a passage score's bands.
BANDS = ((6, "strong"), (3, "adequate"), (0, "weak"))
#: Pages that a report on passages takes, those with most impressions first.
SCORED = 500


def scored(q: Dialect) -> str:
    return f"SELECT url_key, max_passage_query AS query, coalesce(max_passage_impr, 0) AS impressions, floor(max_passage_score * 100 + 0.5) / 100 AS score FROM p_pages WHERE max_passage_score IS NOT NULL ORDER BY impressions DESC, url_key LIMIT {SCORED}"


def passage_bands(q: Dialect) -> str:
    """Each scored page's band and the probability that its best passage answers its query."""
    band = "CASE " + " ".join(f"WHEN score >= {least} THEN '{name}'" for least, name in BANDS) + " ELSE 'none' END"
    return f"SELECT url_key, query, impressions, score, {band} AS band, floor(1000e0 / (1 + exp(-score)) + 0.5) / 1000 AS relevance FROM ({scored(q)}) s"


def passage_quartiles(q: Dialect) -> str:
    """Spread of the scores, by place in their order (floor(share * (n - 1))), and how many are weak."""
    at = lambda share, name: f"max(CASE WHEN place = CAST(floor({share} * (n - 1)) AS BIGINT) THEN score END) AS {name}"
    return f"""SELECT max(n) AS scored, count(CASE WHEN score < 3 THEN 1 END) AS flagged, min(score) AS least, {at('0.25e0', 'p25')}, {at('0.5e0', 'median')}, {at('0.75e0', 'p75')}, max(score) AS most
        FROM (SELECT score, row_number() OVER (ORDER BY score, url_key) - 1 AS place, count(*) OVER () AS n FROM ({scored(q)}) s) t HAVING max(n) > 0"""


# The buckets of positions that a rank overview gives, by the four that are kept.
BUCKETS = {"pos_1_3": ("pos_1", "pos_2_3"), "pos_4_10": ("pos_4_10",), "pos_11_20": ("pos_11_20",), "pos_21_100": tuple(f"pos_{i}1_{i + 1}0" for i in range(2, 9)) + ("pos_91_100",)}


def rank_history(items: DataFrame) -> DataFrame:
    """(year, month, twelve buckets, etv, count ...) -> one row per period with four buckets.

    Rows without a year or month are left out, missing numbers are 0, and a missing total is the sum of the buckets.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in items.columns else F.lit(0)
    total = lambda cs: sum((n(c) for c in cs[1:]), n(cs[0])).cast("long")
    t = items.where(F.col("year").isNotNull() & F.col("month").isNotNull())
    t = t.select(F.format_string("%d-%02d", F.col("year").cast("int"), F.col("month").cast("int")).alias("period"), *[total(cs).alias(name) for name, cs in BUCKETS.items()], n("etv").cast("double").alias("etv"), n("count").cast("long").alias("given"))
    return t.withColumn("keyword_count", F.when(F.col("given") > 0, F.col("given")).otherwise(sum((F.col(c) for c in list(BUCKETS)[1:]), F.col("pos_1_3")))).drop("given")


def upsert_periods(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the periods of new replaced."""
    return old.join(new.select("period"), "period", "left_anti").unionByName(new, allowMissingColumns=True)


# Hosts whose pages are videos or posts, and hosts of discussions.
VIDEO = ("youtube.com", "youtu.be", "tiktok.com", "twitter.com", "x.com", "vimeo.com", "dailymotion.com", "instagram.com", "facebook.com")
DISCUSSION = ("reddit.com", "redd.it")


def route(url: Column) -> Column:
    """How a URL's content is read: as a video, a discussion or a page, by its host or a host above it."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    of = lambda names: F.concat(F.lit("."), host).rlike(r"\.(" + "|".join(n.replace(".", r"\.") for n in names) + ")$")
    return F.when(of(VIDEO), "video").when(of(DISCUSSION), "reddit").otherwise("page")


# States of a to-do, and those that close it.
STATES = ("open", "researching", "drafted", "shipped", "dismissed")
CLOSED = ("shipped", "dismissed")


def add_to_ledger(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with the to-dos that have no entry of the same page and action that isn't closed."""
    live = ledger.where(~F.col("status").isin(*CLOSED)).select("url_key", "action").distinct()
    fresh = new.dropDuplicates(["url_key", "action"]).join(live, ["url_key", "action"], "left_anti").withColumn("status", F.lit("open"))
    return ledger.unionByName(fresh, allowMissingColumns=True)


def update_ledger(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger after changes (url_key, action, status, note, outcome): what a change leaves null stays.

    A change of an unknown status is passed over, as is one of a to-do that isn't there. Notes add up, one a
    line. Closed entries aren't changed; of several changes of one to-do the one furthest on counts.
    """
    order = F.create_map(*[F.lit(x) for i, s in enumerate(STATES) for x in (s, i)])
    known = changes.where(F.col("status").isNull() | F.col("status").isin(*STATES))
    one = known.groupBy("url_key", "action").agg(F.max_by("status", order[F.col("status")]).alias("to"), F.array_join(F.sort_array(F.collect_set("note")), "\n").alias("said"), F.max("outcome").alias("came"))
    rows = ledger
    for c in ("note", "outcome"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    live = ~F.col("status").isin(*CLOSED)
    rows = rows.join(one, ["url_key", "action"], "left")
    note = F.when(live & (F.coalesce("said", F.lit("")) != ""), F.concat_ws("\n", F.col("note"), F.col("said"))).otherwise(F.col("note"))
    return rows.withColumns({"note": note, "outcome": F.when(live, F.coalesce("came", "outcome")).otherwise(F.col("outcome")), "status": F.when(live, F.coalesce("to", "status")).otherwise(F.col("status"))}).drop("to", "said", "came")


def board(ledger: DataFrame) -> DataFrame:
    """To-dos that aren't closed, by page: how many, their priority and states."""
    live = ledger.where(~F.col("status").isin(*CLOSED))
    return live.groupBy("url_key").agg(F.count(F.lit(1)).alias("todos"), F.round(F.sum("priority"), 6).alias("priority"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("states"))
