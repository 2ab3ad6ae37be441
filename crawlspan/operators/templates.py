"""Page templates: pages of one URL shape and one root type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonld import nodes
from ..functions.urls import morphology
from .checks import HTML

LEAST, MOST = 4, 500


def templates(spark) -> DataFrame:
    """shape, type, members, exemplar: the page of median word count among those that are healthy."""
    p = spark.table("p_pages").where("coalesce(is_internal, true) AND " + HTML)
    root = F.coalesce(F.get(F.transform(nodes(F.coalesce("json_ld", F.array().cast("array<string>"))), lambda n: n["type"]), F.lit(0)), F.lit("none"))
    p = p.select("url_key", "word_count", "status_code", morphology(F.col("url_key")).alias("shape"), root.alias("type"))
    p = p.withColumn("healthy", F.coalesce(F.col("status_code") == 200, F.lit(False)) & F.col("word_count").isNotNull())
    by = ["shape", "type"]
    groups = p.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.count_if("healthy").alias("n")).where(F.col("members") >= LEAST)
    # the median's word count from the counts of equal word counts, then its place among the pages that have it
    equal = p.where("healthy").groupBy(*by, "word_count").agg(F.count(F.lit(1)).alias("k")).join(groups, by)
    before = F.sum("k").over(Window.partitionBy(*by).orderBy("word_count").rowsBetween(Window.unboundedPreceding, -1))
    equal = equal.withColumn("rest", F.least(F.floor(F.col("n") / 2) + 1, F.col("n")) - F.coalesce(before, F.lit(0))).where("rest BETWEEN 1 AND k")
    same = p.where("healthy").join(equal.select(*by, "word_count", "rest"), [*by, "word_count"])
    same = same.withColumn("place", F.row_number().over(Window.partitionBy(*by, "word_count").orderBy("url_key"))).where("place = rest")
    return groups.join(same.select(*by, F.col("url_key").alias("exemplar")), by, "left").select(*by, F.least("members", F.lit(MOST)).alias("members"), "exemplar")
