"""Files out, and how long they are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"no such kind of file: {kind}")
    w = df.write.mode("overwrite")
    w = w.partitionBy(*partition_by) if partition_by else w
    (w.option("header", True) if kind == "csv" else w).format(kind).save(path)


def markdown(df: DataFrame, most: int = 500, cell: int = 120) -> str:
    """A table of at most ``most`` rows as text."""
    show = lambda v: "" if v is None else str(v)[:cell].replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in df.limit(most).collect()])


def expired(runs: DataFrame, id_: str, started: str, keep: int = 5) -> DataFrame:
    """The runs beyond the newest ``keep``."""
    every = runs.select(id_, started).distinct()
    newest = every.orderBy(F.desc(started), F.desc(id_)).limit(keep)
    return every.join(F.broadcast(newest), [id_, started], "left_anti").select(id_)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")).select("name", "rows")
        out = one if out is None else out.unionByName(one)
    return out


# Levels of readiness for agents, by score.
LEVELS = ((80, "ready"), (50, "partial"), (20, "minimal"))


def readiness(probes: DataFrame) -> DataFrame:
    """(origin, category, passed) -> score in percent and level."""
    s = probes.groupBy("origin").agg(F.floor(F.count_if("passed") * 100 / F.count(F.lit(1)) + 0.5).cast("int").alias("score"), F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("probes"))
    level = F.lit("none")
    for least, name in reversed(LEVELS):
        level = F.when(F.col("score") >= least, name).otherwise(level)
    return s.withColumn("level", level)
