"""Mixing sources to target weights.

Hash-random keys, a range sort within each source, distributed prefix sums of token counts and a cut
at each source's exact budget; budgets above a source's size repeat it in epochs. All built-in
functions. The range sort cuts the uniform key into equal ranges, so a source with a third of all rows
is spread over as many tasks as it has ranges; prefix sums are taken within ranges, and each range gets
the total of the ranges before it from a table of one row per (source, range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, kept

#: Ranges of one source hold about so many rows.
ROWS_PER_RANGE = 4000
MAX_EPOCHS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...], epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> + weight, target.

    Water filling: every source gets weight * level, at most epochs * its size, and the level is such
    that the targets add up to all sizes. Sorted by cap / weight, the sources that hit their cap are a
    prefix, so one window over the (one row per source) table finds the level. A source without words
    has target 0.
    """
    by_code = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", (F.col("source_size") * epochs).cast("long"))
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").cast("binary").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    first = F.when(F.col("level") <= ratio, F.struct(ratio, F.row_number().over(order), "level"))  # the first that isn't capped
    t = t.withColumn("first", first).withColumn("level", F.min("first").over(everything)["level"])
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.lit(0.0))).alias("target"))


OWN = ("doc_id", "size", "source_size", "target", "taken", "source")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: str = "mix-1", keep: tuple[str, ...] = (), size: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source, + the columns in keep that aren't named like these.

    taken: words that the mix takes of the row, repeats counted: as many whole epochs as fit the target,
    then rows in hash order until the budget is spent; the row at the cut gives only the rest, so a
    source's taken words add up to floor(target). Reruns agree: the key is md5(seed, doc_id).
    Null text has size 0; a null source is a source of its own, last in order; rows with equal doc_id
    share a key and are ordered by size (ties are interchangeable). Empty input gives no rows.
    """
    keep = kept(keep, OWN)
    carried = [F.struct(*keep).alias("kept")] if keep else []  # as one column, so that no name clashes with those used here
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), (n_words(F.col("text")) if size is None else size).alias("size"), *carried)
    base = base.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    narrow = cut(base.select("doc_id", "source", "size", "key")) if not keep else base
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = cut(sizes)  # one row per source
    most = sizes.agg(F.max("n")).first()[0] or 0
    ranges = max(1, min(65536, -(-most // ROWS_PER_RANGE)))
    at = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges / F.lit(2**32)).cast("int")
    plan = targets(sizes.select("source", "source_size"), weights)
    rows = narrow.withColumn("range", at)
    in_range = Window.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    sums = narrow.withColumn("range", at).groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("range_before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    # one row per (source, range), with its source's plan
    ready = cut(sums.alias("s").join(plan.alias("p"), F.expr("s.source <=> p.source")).select("s.source", "range", "range_before", "source_size", "target"))
    out = rows.alias("r").join(ready.alias("t"), F.expr("r.source <=> t.source and r.range = t.range"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("range_before") - F.col("before")))
    return out.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", (whole * F.col("size") + part).cast("long").alias("taken"), F.col("r.source").alias("source"), *(["kept.*"] if keep else []))


SQL = """
WITH b AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3) + 1] AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
             / sum(weight) OVER (ORDER BY cap / weight, encode(source) ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, row_number() OVER (ORDER BY cap / weight, encode(source) ASC NULLS LAST) AS rn FROM l),
m AS (SELECT *, (SELECT arg_min(level, rn) FROM f WHERE level <= cap / weight) AS lv FROM f),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * lv, 0.0)) AS target FROM m),
p AS (SELECT b.*, coalesce(CAST(sum(size) OVER (PARTITION BY source ORDER BY k, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM b),
j AS (SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - before)) AS taken, source FROM j
"""


def query(spark, sf_dir):
    from .common import documents

    return mix_sources(documents(spark, sf_dir))
