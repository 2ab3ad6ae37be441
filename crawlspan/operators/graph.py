"""Link graph: in-degree, internal PageRank and click depth, as joins and aggregates over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BODY, OTHER, DAMPING, ROUNDS, CLOSE = 1.0, 0.2, 0.85, 30, 1e-6
#: Lineage is cut and convergence looked at every so many rounds.
CHECK_EVERY = 5


def shared_dir(spark) -> str:
    """The folder for what is written between steps: the one that the session names. Only a local session may go without."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        import tempfile

        _OWN.append(tempfile.mkdtemp(prefix="crawlspan-"))
    return _OWN[0]


#: The folder of a local session without one.
_OWN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def indegree(pages: DataFrame, links: DataFrame) -> DataFrame:
    """url_key, inlink_count: internal link rows that aren't self-links."""
    n = links.where("is_internal AND source_key <> target_key").groupBy(F.col("target_key").alias("url_key")).agg(F.count(F.lit(1)).alias("inlink_count"))
    return pages.select("url_key").join(n, "url_key", "left").fillna(0, ["inlink_count"])


def ipr(pages: DataFrame, links: DataFrame, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """url_key, rank (probability), ipr (0 to 100 on a log scale). Links outside the body weigh a fifth; rank of pages without links is spread over all."""
    nodes = cut(pages.select("url_key").distinct())
    n = nodes.count()
    if not n:
        return nodes.select("url_key", F.lit(0.0).alias("rank"), F.lit(0).alias("ipr"))
    e = links.where("is_internal AND source_key <> target_key").join(nodes.select(F.col("url_key").alias("source_key")), "source_key", "left_semi").join(nodes.select(F.col("url_key").alias("target_key")), "target_key", "left_semi")
    e = e.groupBy("source_key", "target_key").agg(F.sum(F.when(F.col("placement") == "body", BODY).otherwise(OTHER)).alias("w"))
    e = cut(e.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("source_key"))))
    linking = e.select(F.col("source_key").alias("url_key")).distinct().withColumn("links", F.lit(True))
    rank = cut(nodes.join(linking, "url_key", "left").select("url_key", F.coalesce("links", F.lit(False)).alias("links"), F.lit(1.0 / n).alias("rank"), F.lit(1.0 / n).alias("was")))
    for i in range(1, rounds + 1):
        got = e.join(rank.where("links").select(F.col("url_key").alias("source_key"), "rank"), "source_key").groupBy(F.col("target_key").alias("url_key")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        loose = rank.agg(F.coalesce(F.sum(F.when(~F.col("links"), F.col("rank"))), F.lit(0.0)).alias("loose"))
        rank = rank.join(got, "url_key", "left").crossJoin(F.broadcast(loose)).select("url_key", "links", ((1 - DAMPING) / n + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"), F.col("rank").alias("was"))
        if i % CHECK_EVERY == 0 or i == rounds:
            rank = cut(rank)
            if rank.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < close:
                break
    ends = rank.agg(F.min(F.log("rank")).alias("lo"), F.max(F.log("rank")).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.log("rank") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return rank.crossJoin(F.broadcast(ends)).select("url_key", "rank", F.floor(scaled * 100 + 0.5).cast("int").alias("ipr"))


def click_depth(pages: DataFrame, links: DataFrame, seed: str | None = None) -> DataFrame:
    """url_key, click_depth: clicks from the seed over body links; null where they don't lead. Without a seed that was crawled: the shallowest page with most links."""
    nodes = cut(pages.select("url_key", "depth", "inlink_count"))
    e = cut(links.where("is_internal AND placement = 'body' AND source_key <> target_key").select("source_key", "target_key").distinct())
    start = nodes.where(F.col("url_key") == F.lit(seed)).select("url_key").limit(1)
    if seed is None or start.isEmpty():
        start = nodes.orderBy(F.asc_nulls_last("depth"), F.desc_nulls_last("inlink_count"), "url_key").select("url_key").limit(1)
    seen = cut(start.select("url_key", F.lit(0).alias("click_depth")))
    front, d = seen, 0
    while not front.isEmpty():
        d += 1
        reached = e.join(front.select(F.col("url_key").alias("source_key")), "source_key").select(F.col("target_key").alias("url_key")).distinct()
        front = cut(reached.join(nodes.select("url_key"), "url_key", "left_semi").join(seen, "url_key", "left_anti").select("url_key", F.lit(d).alias("click_depth")))
        seen = cut(seen.unionByName(front)) if d % CHECK_EVERY == 0 else seen.unionByName(front)
    return nodes.select("url_key").join(seen, "url_key", "left")
