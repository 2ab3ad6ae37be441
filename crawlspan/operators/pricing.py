"""Pricing of findings: priority = T * Y * C / E, and the audit that unions all checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import SPARK
from .checks import CHECKS, totals, win

# Yield by category, its factor by severity, assumed share and floor of traffic by severity, effort scale by kind of fix, findings kept per check.
YIELD = {"indexation": 0.8, "crawlability": 0.7, "merged": 0.4, "security": 0.5, "schema": 0.3, "content": 0.25, "onpage": 0.2, "performance": 0.5, "war-stories": 0.5}
YIELD_ELSE = 0.25
ADJUST = {"crit": 1.1, "high": 1.0, "med": 0.7, "low": 0.15, "info": 0.05}
SITE_SHARE = {"crit": 0.25, "high": 0.12, "med": 0.04, "low": 0.01, "info": 0.005}
FLOOR = {"crit": 5.0, "high": 2.0, "med": 0.5, "low": 0.1, "info": 0.05}
SCALE = {"global": 1.0, "automated": 1.2}
KEPT = 500
RANK = {"crit": 0, "high": 1, "med": 2, "low": 3, "info": 4}


def lookup(values: dict, col: str):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(col)]


def metadata(spark) -> DataFrame:
    rows = [(c.id, c.category, c.severity, c.labels, float(c.certainty), float(c.effort), c.fix) for c in CHECKS.values()]
    return spark.createDataFrame(rows, "check_id string, category string, severity string, labels string, certainty double, effort_base double, fix_type string")


STANDARD = {"query": "string", "clicks": "double", "impressions": "double", "position": "double"}


def common(id: str, df: DataFrame) -> DataFrame:
    """A check's rows with the columns that pricing reads, and all evidence as JSON; capped rows keep the check's true count."""
    top = CHECKS[id].top
    order = [F.desc(top)] if top and top in df.columns else []
    evidence = [c for c in df.columns if c != "url_key"]
    key = F.coalesce(F.col("url_key"), F.lit(""))
    ev = F.to_json(F.struct(*evidence)) if evidence else F.lit("{}")
    found = df.agg(F.count(F.lit(1)).alias("found"))
    rows = df.select(F.lit(id).alias("check_id"), "url_key", *[(F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in STANDARD.items()], ev.alias("evidence"), *[F.col(top).alias("_top") for _ in order])
    kept = rows.orderBy(*[F.desc("_top") for _ in order], key, "evidence").limit(KEPT).drop("_top")
    return kept.crossJoin(F.broadcast(found))


def price(findings: DataFrame, spark) -> DataFrame:
    """check_id, url_key ... -> + traffic at risk, yield, effort, priority."""
    page = spark.sql(totals(win() + " AND page_key IS NOT NULL")).select(F.col("page_key").alias("url_key"), F.col("clicks").cast("double").alias("pg_clicks"), F.col("impressions").cast("double").alias("pg_impr"), F.col("position").alias("pg_pos"))
    site = spark.sql(f"SELECT CAST(coalesce(sum(clicks), 0) AS DOUBLE) AS site_clicks FROM p_sa WHERE {win()}")
    f = findings.join(F.broadcast(metadata(spark)), "check_id").join(page, "url_key", "left").join(F.broadcast(site))
    by_query = F.coalesce(F.col("query"), F.lit("")) != ""
    on_page = F.col("pg_clicks").isNotNull()
    own = by_query | ~on_page
    f = f.withColumn("t_clicks", F.coalesce(F.when(own, F.col("clicks")).otherwise(F.col("pg_clicks")), F.lit(0.0)))
    f = f.withColumn("t_impr", F.coalesce(F.when(own, F.col("impressions")).otherwise(F.col("pg_impr")), F.lit(0.0)))
    f = f.withColumn("t_pos", F.when(own, F.coalesce("position", "pg_pos")).otherwise(F.col("pg_pos")))
    at_risk = F.greatest("t_clicks", F.col("t_impr") * F.expr(SPARK.ctr("coalesce(t_pos, 10)")))
    t = F.when((F.col("t_clicks") > 0) | (F.col("t_impr") > 0), at_risk).when(F.col("url_key").isNull(), F.col("site_clicks") * lookup(SITE_SHARE, "severity")).otherwise(0.0)
    f = f.withColumn("traffic", F.greatest(t, lookup(FLOOR, "severity")))
    f = f.withColumn("yield", F.least(F.lit(1.0), F.coalesce(lookup(YIELD, "category"), F.lit(YIELD_ELSE)) * lookup(ADJUST, "severity")))
    scale = F.coalesce(lookup(SCALE, "fix_type"), F.log10(F.col("found") + 9))
    f = f.withColumn("effort", F.greatest(F.col("effort_base") * scale, F.lit(1e-4)))
    return f.withColumn("priority", F.col("traffic") * F.col("yield") * F.col("certainty") / F.col("effort"))


OUT = ["check_id", "category", "severity", "url_key", "query", "evidence", "found", "traffic", "yield", "certainty", "effort", "priority"]


#: Checks of one plan. A single plan of all would take Catalyst minutes.
BATCH = 8


def run_audit(spark, categories: list[str] | None = None, judgement: bool = True, ids: list[str] | None = None) -> DataFrame:
    """All findings of the property whose views are registered, with their prices.

    The tables that most checks read are kept while they run; findings are cut from their lineage batch by batch.
    """
    from .graph import cut
    from .structured import build

    use = [c for c in CHECKS.values() if (not categories or c.category in categories) and (judgement or c.certainty >= 1) and (ids is None or c.id in ids)]
    base = [spark.table(t).persist() for t in ("p_sa", "p_pages", "p_links")]
    try:
        parts = [cut(reduce(DataFrame.unionByName, [common(c.id, build(c.id, spark)) for c in use[i : i + BATCH]])) for i in range(0, len(use), BATCH)]
        return cut(price(reduce(DataFrame.unionByName, parts), spark).select(*OUT))
    finally:
        for t in base:
            t.unpersist()


def report(findings: DataFrame, top: int = 25) -> DataFrame:
    """The top findings with an impact index (100 for the largest) and a size."""
    most = findings.agg(F.max("priority").alias("most"))
    r = findings.join(F.broadcast(most)).withColumn("impact", F.floor(F.col("priority") / F.col("most") * 100 + 0.5).cast("int"))
    size = F.when(F.col("impact") >= 50, "XL").when(F.col("impact") >= 20, "L").when(F.col("impact") >= 5, "M").otherwise("S")
    return r.withColumn("size", size).orderBy(F.desc("priority"), "check_id", F.asc_nulls_first("url_key"), "evidence").limit(top).drop("most")


def summary(findings: DataFrame) -> DataFrame:
    """Findings by check: true and kept counts, total priority."""
    return findings.groupBy("category", "severity", "check_id").agg(F.max("found").alias("found"), F.count(F.lit(1)).alias("kept"), F.round(F.sum("priority"), 6).alias("priority"))


def recommendations(findings: DataFrame) -> DataFrame:
    """Categories by their worst severity, with up to three examples of each check."""
    rank = lookup(RANK, "severity")
    three = findings.withColumn("n", F.row_number().over(Window.partitionBy("check_id").orderBy(F.desc("priority"), F.asc_nulls_first("url_key"), "evidence"))).where("n <= 3")
    by = three.groupBy("category", "check_id", "severity").agg(F.max("found").alias("found"), F.sort_array(F.collect_list(F.coalesce("url_key", "query", F.lit("site")))).alias("examples"))
    return by.withColumn("worst", F.min(rank).over(Window.partitionBy("category"))).orderBy("worst", "category", rank, "check_id")
