"""Incremental and streaming ingest of search facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("date", "query", "page_key", "device", "country")


def latest(rows: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """One row per key: of the highest version, if there is such a column."""
    if "version" not in rows.columns:
        return rows.dropDuplicates(list(key))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc_nulls_last("version")))).where("_n = 1").drop("_n")


def merge_facts(old: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """old with the rows of new replacing those of their key.

    Of equal keys in new, the highest version (column version, if there is one) wins; if old has versions,
    too, a stored row of a higher version stays. Columns that only one side has are kept, null for the other.
    """
    if "version" in new.columns and "version" in old.columns:
        both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
        order = Window.partitionBy(*key).orderBy(F.desc_nulls_last("version"), F.desc("_new"))
        return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")
    new = latest(new, key)
    same = None
    for c in key:
        e = F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
        same = e if same is None else same & e
    kept = old.alias("o").join(new.select(*key).alias("n"), same, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def conflicts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """reason: why the batch can't be merged: the stored facts are of another search type, or one side has a device per row and the other none. No rows: it can.

    A table of facts has one shape and one search type, as sums over it would count twice otherwise. A caller
    that means to replace the stored facts passes the batch's rows alone, so nothing is lost before they are there.
    """
    shape = lambda df: df.agg(F.bool_or(F.coalesce("device", F.lit("")) != "").alias("by_device"), F.bool_or(F.coalesce("device", F.lit("")) == "").alias("whole"), F.array_sort(F.collect_set(F.coalesce("search_type", F.lit("web")))).alias("types"))
    s, b = shape(stored).select(*[F.col(c).alias(f"s_{c}") for c in ("by_device", "whole", "types")]), shape(batch)
    mixed = (F.col("s_by_device") & F.col("whole")) | (F.col("s_whole") & F.col("by_device")) | (F.col("by_device") & F.col("whole"))
    other = (F.size("s_types") > 0) & (F.size("types") > 0) & (F.size(F.array_union("s_types", "types")) > 1)
    reasons = F.array_compact(F.array(F.when(mixed, "shape"), F.when(other, "search type")))
    return s.crossJoin(F.broadcast(b)).select(F.explode(reasons).alias("reason"))


def resume_from(facts: DataFrame, lag_days: int = 3) -> DataFrame:
    """start: the first day to pull again, as the last days are restated."""
    return facts.agg(F.date_sub(F.max("date"), lag_days).alias("start"))


def stored_days(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at path. Any other trouble with it raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path, "date=*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def replace_days(spark: SparkSession, path: str, batch: DataFrame, epoch: int = 0) -> None:
    """foreachBatch sink: days of the batch are merged with what is stored of them and rewritten; other days' partitions aren't touched.

    Columns may be added from batch to batch; version, if there is one, is stored. Days don't lose rows: a
    stored row goes only for one of its key.
    """
    from ..operators.graph import cut

    out = latest(batch)
    if stored_days(spark, path):
        days = batch.select("date").distinct()
        stored = spark.read.option("mergeSchema", True).parquet(path)
        out = merge_facts(stored.join(F.broadcast(days), "date", "left_semi"), batch)
    # the partitions that are overwritten are read for it, so the result is cut from them first
    cut(out).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def daily_final(events: DataFrame, late: str = "3 days") -> DataFrame:
    """Daily totals, each emitted once its day can't change any more."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.to_date("window.start").alias("date"), "event_type", "n", "value")


def sliding(events: DataFrame, late: str = "3 days", length: str = "7 days", step: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_snapshots(pages: DataFrame) -> DataFrame:
    """The first row of each (crawl, page) in arrival order; a restart doesn't add others."""
    return pages.dropDuplicates(["crawl_id", "url_key"])


def run_once(spark: SparkSession, frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A stream over what is there now, run to its end into a table in memory: for tests and small reports."""
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
