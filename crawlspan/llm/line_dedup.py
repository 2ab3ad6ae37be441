"""Line dedup by content-defined line chunks.

A rolling hash over the hashes of the last lines chooses boundaries, so inserted or missing lines move
only the boundaries next to them. A chunk ends only once it has LEAST lines that aren't blank, and what is
left at the end of a text with fewer goes with the chunk before, so a copied text of that many lines has no
chunk too short to count. Chunks of several lines that occur more than once anywhere are
compared byte by byte; all but their first occurrence (smallest document id, then place) are removed.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept, python_batches

#: Lines in the rolling window; one boundary in so many lines on average, if chunks are long enough; lines of a chunk at least that aren't blank.
WINDOW, EVERY, LEAST = 2, 2, 2
MASK = (1 << 64) - 1
#: Occurrences of one hash that meet in a task, about; more are spread by a salt.
TOGETHER = 2000
#: Rows of a small side that is broadcast, at most; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000


def chunks(text: str) -> list[str]:
    """Chunks of whole lines; joined by line feeds they give the text."""
    lines = text.split("\n")
    hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines]
    out, ends, first, rolling, filled = [], [], 0, 0, 0
    out_of = pow(0x9E3779B97F4A7C15, WINDOW, 1 << 64)
    for i, h in enumerate(hashes):
        rolling = (rolling * 0x9E3779B97F4A7C15 + h) & MASK
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * out_of) & MASK
        filled += bool(lines[i].strip())
        if filled >= LEAST and (rolling ^ rolling >> 31) * 0xBF58476D1CE4E5B9 % (1 << 64) >> 33 < (1 << 31) // EVERY:
            ends.append(i + 1)
            filled = 0
    if ends and filled < LEAST:
        ends.pop()
    for end in (*ends, len(lines)):
        out.append("\n".join(lines[first:end]))
        first = end
    return out


def counts(chunk: str) -> bool:
    """Whether the chunk has enough lines that aren't blank."""
    return chunk.count("\n") + 1 >= LEAST and sum(1 for x in chunk.split("\n") if x.strip()) >= LEAST


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns in keep, text without repeated chunks, + n_lines, removed_lines (long; kept columns of these names are left out).

    Null text stays null with 0 lines. Rows with the same id and text share their occurrences, so
    repeated rows keep what the first keeps. A null id counts as the smallest. Empty input gives no rows.
    A chunk repeated by very many rows is spread over tasks by a salt, of which its first occurrence has copies.
    """
    keep = kept(keep, ("n_lines", "removed_lines", "__row", "__gone"))
    key = F.xxhash64("doc_id", "text")
    src = python_batches(docs).where(F.col("text").contains("\n")).select("doc_id", "text", key.alias("row"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cutter(with_text):
        def run(batches):
            for b in batches:
                out = []
                for d, r, t in zip(b["doc_id"], b["row"], b["text"], strict=True):
                    for i, c in enumerate(chunks(t)):
                        if counts(c):
                            h = xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass"))
                            h -= (h >> 63) << 64
                            out.append((d, r, i, h, c) if with_text else (h,))
                yield pd.DataFrame(out, columns=["doc_id", "row", "i", "h", "chunk"] if with_text else ["h"])

        return run

    hashes = src.mapInPandas(cutter(False), "h long")
    repeated = cut(hashes.groupBy("h").count().where("count > 1").select("h", F.ceil(F.col("count") / TOGETHER).cast("int").alias("salts")))
    found = src.mapInPandas(cutter(True), f"doc_id {kind}, row long, i int, h long, chunk string")
    # only chunks with a repeated hash go on with their bytes
    found = cut(found.join(_small(repeated), "h").withColumn("salt", F.pmod(F.xxhash64("row", "i"), F.col("salts")).cast("int")))
    first = found.groupBy("h", "chunk", "salts").agg(F.min(F.struct("doc_id", "i", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select("h", "chunk", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    gone = found.join(first, ["h", "salt", "chunk"]).where(F.struct("doc_id", "i", "row") != F.col("first")).groupBy("row").agg(F.collect_set("i").alias("__gone"))
    gone = cut(gone.withColumnRenamed("row", "__row"))
    rows = docs.select(*keep, *(() if "text" in keep else ("text",)), key.alias("__row")).join(_small(gone), "__row", "left").drop("__row")
    out_schema = rows.drop("__gone").withColumn("n_lines", F.lit(0).cast("long")).withColumn("removed_lines", F.lit(0).cast("long")).schema

    def rebuild(batches):
        for b in batches:
            texts, n, cut_lines = [], [], []
            for t, g in zip(b["text"], b["__gone"], strict=True):
                total = t.count("\n") + 1 if isinstance(t, str) else 0
                removed = 0
                if g is not None and isinstance(t, str):
                    gone_ = set(map(int, g))
                    parts = chunks(t)
                    removed = sum(parts[i].count("\n") + 1 for i in gone_)
                    t = "\n".join(c for i, c in enumerate(parts) if i not in gone_)
                texts.append(t if isinstance(t, str) else None)
                n.append(total)
                cut_lines.append(removed)
            out = b.drop(columns="__gone").copy()
            out["text"], out["n_lines"], out["removed_lines"] = texts, n, cut_lines
            yield out

    return rows.mapInPandas(rebuild, out_schema)


def query(spark, sf_dir):
    from .common import documents

    return dedup_lines(documents(spark, sf_dir))
