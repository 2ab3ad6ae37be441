"""The ad-hoc query operator: a validated specification becomes a plan; no SQL text is ever made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("sa", "pages", "links", "inspection", "backlinks", "cwv", "sitemap", "keywords")
MAX_KEYS, MAX_METRICS, MAX_FILTERS, MAX_IN, MAX_ROWS, CELL = 4, 6, 8, 100, 500, 120
COMPARE = {"eq": "eqNullSafe", "ne": None, "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
#: Columns that rows mode shows unless told otherwise.
DEFAULTS = {"sa": ["date", "query", "page_key", "clicks", "impressions", "position"], "pages": ["url_key", "status_code", "indexable", "title", "word_count", "inlink_count", "ipr"]}


class BadQuery(ValueError):
    pass


def condition(df: DataFrame, column: str, op: str, value):
    c = F.col(column)
    if op == "like":
        return c.ilike(str(value))
    if op == "in":
        if not isinstance(value, list) or not 0 < len(value) <= MAX_IN:
            raise BadQuery(f"in takes 1 to {MAX_IN} values")
        return c.isin(*value)
    if op not in COMPARE:
        raise BadQuery(f"no such operator: {op}")
    if op == "ne":
        return ~c.eqNullSafe(F.lit(value)) if value is None else c != F.lit(value)
    return getattr(c, COMPARE[op])(F.lit(value))


def query_data(spark, table: str, mode: str = "aggregate", group_by: tuple[str, ...] = (), metrics: tuple[tuple[str, str], ...] = (), filters: tuple[tuple, ...] = (), order_by: str | None = None, descending: bool = True, limit: int | None = None, offset: int = 0, columns: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate: keys, count, pct, fn_column metrics. Rows: chosen columns, long text cut for display."""
    if table not in TABLES or mode not in ("aggregate", "rows"):
        raise BadQuery(f"no such table or mode: {table}, {mode}")
    df = spark.table("p_" + table)
    kinds = {f.name: f.dataType for f in df.schema}
    for c in (*group_by, *columns, *(c for _, c in metrics), *(f[0] for f in filters)):
        if c not in kinds:
            raise BadQuery(f"no such column: {c}")
    if len(group_by) > MAX_KEYS or len(metrics) > MAX_METRICS or len(filters) > MAX_FILTERS:
        raise BadQuery("too many keys, metrics or filters")
    limit = (25 if mode == "aggregate" else 50) if limit is None else limit
    if not 1 <= limit <= MAX_ROWS or offset < 0:
        raise BadQuery(f"limit is 1 to {MAX_ROWS}, offset 0 or more")
    for f in filters:
        df = df.where(condition(df, *f))
    if mode == "aggregate":
        fns = {"sum": F.sum, "avg": lambda c: F.round(F.avg(c), 2), "min": F.min, "max": F.max}
        for fn, c in metrics:
            if fn not in fns or not isinstance(kinds[c], T.NumericType):
                raise BadQuery(f"{fn} of {c} isn't a metric")
        out = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("count"), *[fns[fn](c).alias(f"{fn}_{c}") for fn, c in metrics])
        total = df.agg(F.count(F.lit(1)).alias("_total"))
        out = out.join(F.broadcast(total)).withColumn("pct", F.floor(F.col("count") * 1000.0 / F.col("_total") + 0.5) / 10).drop("_total")
        by = order_by or "count"
        ties = [c for c in group_by if c != by]
    else:
        use = list(columns) or DEFAULTS.get(table) or [c for c, k in kinds.items() if not isinstance(k, (T.ArrayType, T.MapType))]
        show = lambda c: F.when(F.length(c) > CELL, F.concat(F.substring(c, 1, CELL), F.lit("…"))).otherwise(F.col(c)).alias(c) if isinstance(kinds[c], T.StringType) else F.col(c)
        out, by = df.select(*map(show, use)), order_by
        ties = [c for c in use if c != by]
    if by is not None and by not in out.columns:
        raise BadQuery(f"can't order by {by}")
    order = [] if by is None else [F.desc(by) if descending else F.asc(by)]
    return out.orderBy(*order, *ties).offset(offset).limit(limit)


def paging(spark, table: str, filters: tuple[tuple, ...] = (), limit: int = 50, offset: int = 0) -> DataFrame:
    """total, returned, next_offset (null at the end): where a page of rows mode stands among the rows that fit."""
    if table not in TABLES:
        raise BadQuery(f"no such table: {table}")
    df = spark.table("p_" + table)
    for f in filters:
        if f[0] not in df.columns:
            raise BadQuery(f"no such column: {f[0]}")
        df = df.where(condition(df, *f))
    last = F.least(F.col("total"), F.lit(offset + limit).cast("long"))
    t = df.agg(F.count(F.lit(1)).alias("total"))
    return t.select("total", F.greatest(F.lit(0).cast("long"), last - offset).alias("returned"), F.when(last < F.col("total"), last).alias("next_offset"))
