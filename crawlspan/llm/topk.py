"""Exact top-k search by incremental multi-index hashing of binary codes.

A vector's code is its signs. Codes are cut into segments of ``SEGMENT`` bits, each with an index from
its value to the codes that have it. Queries probe all segments at radius 0, 1, 2 ...: once all segments
are searched to radius r, every code within m * (r + 1) - 1 bits has been seen (by pigeonhole, one of
its m segments is within r), so a query ends when its k-th verified distance is within that.

Codes are searched once, however many rows share them: a code keeps its k smallest ids, all that a
result can need. All built-in functions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEGMENT = 16
K = 10
QUERY_EVERY = 20
#: Index rows that are broadcast, at most; beyond, probes and index are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def code(vector: Column, dims: int) -> Column:
    """Segment values of the sign bits (1 for a positive component; null and missing count as 0)."""
    parts = []
    for at in range(0, dims, SEGMENT):
        bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << (i - at))).otherwise(F.lit(0)) for i in range(at, min(dims, at + SEGMENT))]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        parts.append(total.cast("int"))
    return F.array(*parts)


def distance(a: Column, b: Column, segments: int) -> Column:
    total = F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0))))
    for i in range(1, segments):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total.cast("int")


def smallest(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, neighbor_id, distance, rank: the k rows with the smallest (distance, id) of each query.

    rows, queries: (id, vector). A query that is itself a row finds itself. Null vectors are neither
    found nor searched. Equal ids in rows count once per different code; equal queries give one result.
    With fewer than k rows, all are returned. Components that a shorter vector lacks count as not positive.
    """
    size = F.max(F.size("vector")).alias("n")
    # of both sides: what a longer query has beyond the rows counts, too
    dims = max(1, rows.agg(size).unionByName(queries.agg(size)).agg(F.max("n")).first()[0] or 1)
    m = -(-dims // SEGMENT)
    coded = lambda df: df.where(F.col("vector").isNotNull()).select("id", code(F.col("vector"), dims).alias("code"))
    base = cut(smallest(coded(rows).distinct(), ["code"], ["id"], k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = coded(queries).distinct()
    # within: the query's k-th verified distance so far; nothing farther can be in its result
    open_ = cut(asked.select(F.col("code").alias("q"), (F.size("code") * SEGMENT).alias("within")).distinct())
    index = base.select(F.posexplode("code").alias("j", "v"), "code", "ids")
    index = F.broadcast(index) if base.limit(BROADCAST_ROWS // m + 1).count() * m <= BROADCAST_ROWS else index
    best, done = None, []
    for radius in range(SEGMENT + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), radius)]
        probes = open_.select("q", "within", F.posexplode("q").alias("j", "s")).select("q", "within", "j", F.explode(F.transform(F.array(*[F.lit(x) for x in masks]) if len(masks) < 100 else F.from_json(F.lit(str(masks)), "array<int>"), lambda x: x)).alias("x"), "s")
        probes = probes.select("q", "within", "j", F.col("s").bitwiseXOR(F.col("x")).alias("v")).alias("p")
        far = distance(F.col("q"), F.col("code"), m)
        seen = probes.join(index.alias("i"), F.expr("p.j = i.j and p.v = i.v") & (far <= F.col("within"))).select("q", far.alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            seen = seen.unionByName(best)
        # a code can turn up through several segments
        best = cut(smallest(seen.distinct(), ["q"], ["distance", "id"], k))
        bound = m * (radius + 1) - 1
        kth = cut(best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).where(F.col("n") >= k))
        full = kth.where(F.col("d") <= bound).select("q")
        done.append(best.join(full, "q", "left_semi"))
        open_ = cut(open_.join(full, "q", "left_anti").join(kth, "q", "left").select("q", F.coalesce("d", F.lit(dims)).alias("within")))
        best = cut(best.join(full, "q", "left_anti"))
        if open_.isEmpty():
            break
    else:
        done.append(best)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = asked.withColumnRenamed("id", "query_id").withColumnRenamed("code", "q").join(out, "q")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy("distance", "id"))
    return out.select("query_id", F.col("id").alias("neighbor_id"), "distance", rank.alias("rank"))


def query(spark, sf_dir):
    """Queries are all rows whose id is divisible by 20, against all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(rows, rows.where(F.col("id") % QUERY_EVERY == 0))


SQL = """
WITH b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END).array_to_string('')::BIT AS c FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.id AS query_id, r.id AS neighbor_id, CAST(bit_count(xor(q.c, r.c)) AS INTEGER) AS distance FROM b q, b r WHERE q.id % 20 = 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM p)
SELECT query_id, neighbor_id, distance, rank FROM o WHERE rank <= 10
"""
