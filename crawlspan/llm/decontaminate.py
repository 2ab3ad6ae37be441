"""Benchmark decontamination by greedy string tiling.

Seeds are shared runs of five tokens. A document that an item contaminates has most of the item's seeds, so
the most frequent ones needn't be looked for: as many of each item's seeds go, the commonest first, as can't
make up the overlap alone. A bit map of the seeds that stay, of a fixed size at most, tells which
positions of a document may begin one; those are joined with the table of seeds, on their hash, into pairs of
a text and an item. Of each pair, running Karp-Rabin repeatedly marks the longest matches that don't overlap
marked tokens, down to the seed length; a document is contaminated by an item if tiles cover at least
``coverage`` of the item's tokens, in whatever order its passages stand.

Tokens are runs of letters and digits; in scripts that are written without spaces, single characters. Rows
with the same text are one class throughout. Neither documents nor the benchmark go through the driver.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, kept, mix, python_batches, word_hashes

SEED = 5
COVERAGE = 0.8
#: Bits of the map of seeds for each of them, and in all, at most (16 MB); with more seeds it only filters less.
BITS_EACH, BITS = 64, 1 << 27
#: Rows of a small side that is broadcast, at most; beyond, it is joined by a shuffle, with hot seeds spread over so many salts.
BROADCAST_ROWS, SALTS = 500_000, 16
#: Bytes of the items that are broadcast to be verified, at most.
BROADCAST_BYTES = 16 << 20
# Thai, Lao, Myanmar, Khmer, kana, ideographs
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF"
TOKEN = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")
LEAK = "array<struct<item_id:{},item_tokens:int,covered:int,coverage:double,tiles:array<struct<doc_start:int,item_start:int,length:int>>>>"


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def token_hashes(words: list[str]) -> np.ndarray:
    return word_hashes(np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass"), np.uint8))


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(ids) - k + 1)
    h = np.full(n, np.uint64(k), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + ids[i : i + n].astype(np.uint64))
    return h


def least(n: int, k: int, coverage: float) -> int:
    """Seeds of an item of n tokens that tiles of at least k tokens have, if they cover enough: a tile of m tokens has m - k + 1, at least m / k."""
    return max(1, math.ceil(math.ceil(coverage * n - 1e-9) / k))


class KarpRabin:
    """Hashes of any window from prefix sums of a rolling polynomial modulo 2**61 - 1."""

    P, X = (1 << 61) - 1, 911382323

    def __init__(self, ids: list[int]):
        self.h, self.p = [0], [1]
        for i in ids:
            self.h.append((self.h[-1] * self.X + i + 2) % self.P)
            self.p.append(self.p[-1] * self.X % self.P)

    def of(self, at: int, n: int) -> int:
        return (self.h[at + n] - self.h[at] * self.p[n]) % self.P


def tile(doc: list[int], item: list[int], least: int, starts: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiles (doc start, item start, length), by running Karp-Rabin.

    starts: the positions of doc where a match of ``least`` tokens can begin (all, if None).
    """
    kd, ki = KarpRabin(doc), KarpRabin(item)
    marked_d, marked_i = bytearray(len(doc)), bytearray(len(item))
    if starts is None:
        starts = list(range(len(doc) - least + 1))
    tiles, s = [], max(least, len(item) // 2)
    while True:
        table: dict[int, list[int]] = {}
        for j in range(len(item) - s + 1):
            if not any(marked_i[j : j + s]):
                table.setdefault(ki.of(j, s), []).append(j)
        found, longest = [], 0
        for i in starts if table else ():
            if i + s > len(doc) or any(marked_d[i : i + s]):
                continue
            for j in table.get(kd.of(i, s), ()):
                if doc[i : i + s] != item[j : j + s]:
                    continue
                n = s
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not marked_d[i + n] and not marked_i[j + n]:
                    n += 1
                found.append((-n, i, j))
                longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for n, i, j in sorted(found):
            n = -n
            if any(marked_d[i : i + n]) or any(marked_i[j : j + n]):
                again = True  # occluded: what is left of it may still be long enough
                continue
            marked_d[i : i + n] = marked_i[j : j + n] = b"\1" * n
            tiles.append((i, j, n))
        if again and tiles:
            continue
        if s == least:
            return tiles
        s = max(least, s // 2)


def verified(doc: list[str], item: list[str], coverage: float, doc_hashes: np.ndarray | None = None) -> dict | None:
    """The leak of an item into a document, by its tiles, if they cover enough of it."""
    if not item:
        return None
    k = min(SEED, len(item))
    of_doc = window_hashes(token_hashes(doc) if doc_hashes is None else doc_hashes, k)
    of_item = window_hashes(token_hashes(item), k)
    reach = np.zeros(len(item) + 1, np.int64)
    j = np.flatnonzero(np.isin(of_item, of_doc))
    np.add.at(reach, j, 1)
    np.add.at(reach, j + k, -1)
    if (np.cumsum(reach)[:-1] > 0).sum() < coverage * len(item):  # tiles can't cover more
        return None
    # only stretches of the document that shared seeds cover are tiled, with a gap between them
    starts = np.flatnonzero(np.isin(of_doc, of_item)).tolist()
    vocab: dict[str, int] = {}
    ids = [vocab.setdefault(t, len(vocab)) for t in item]
    place, short, first, gap = [], [], [], -3
    for i in starts:
        frm = place[-1] + 1 if place else 0
        if i > frm and place:
            short.append(gap)
            place.append(i - 1)
            gap -= 1
        frm = max(i, frm)
        first.append(len(place) - max(0, frm - i))
        for x in range(frm, i + k):
            short.append(vocab.setdefault(doc[x], len(vocab)))
            place.append(x)
    tiles = tile(short, ids, k, first)
    covered = sum(n for _, _, n in tiles)
    if covered < coverage * len(item):
        return None
    return {"item_tokens": len(item), "covered": covered, "coverage": covered / len(item), "tiles": [{"doc_start": place[i], "item_start": j, "length": n} for i, j, n in sorted(tiles)]}


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def seed_table(items: DataFrame, coverage: float) -> DataFrame:
    """(ik, text) -> ik, k, h: the seeds that documents are searched for."""

    def run(batches):
        for b in batches:
            out = []
            for i, t in zip(b["ik"], b["text"], strict=True):
                words = tokens(t)
                if words:
                    k = min(SEED, len(words))
                    h, n = np.unique(window_hashes(token_hashes(words), k), return_counts=True)
                    out += [(i, k, x, m, least(len(words), k, coverage)) for x, m in zip(h.view(np.int64).tolist(), n.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["ik", "k", "h", "times", "need"])

    seeds = cut(python_batches(items).mapInPandas(run, "ik long, k int, h long, times int, need int"))
    seeds = seeds.join(seeds.groupBy("h").agg(F.count(F.lit(1)).alias("items")), "h")
    # from the commonest on, seeds go while all that went together can't be enough
    w = F.sum("times").over(Window.partitionBy("ik").orderBy(F.desc("items"), "h").rowsBetween(Window.unboundedPreceding, 0))
    return cut(seeds.withColumn("sofar", w).where("sofar >= need").select("ik", "k", "h"))


def bit_map(seeds: DataFrame) -> bytes:
    """Two bits of each seed's hash, in a map of BITS bits at most, aggregated in Spark."""
    n = seeds.count()
    size = min(BITS, max(1 << 15, 1 << (BITS_EACH * n).bit_length()))
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1))))
    rows = seeds.select(at.alias("x")).select((F.col("x") + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    out = bytearray(size // 8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] = r.bits
    return bytes(out)


def annotate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep (but one named leaks), + leaks: the items that contaminate the row, by id, with coverage and tiles.

    Whole texts are searched. Null or empty documents and items never match; an item of fewer than five
    tokens matches as a whole. Repeated rows are each reported; of repeated items with one id and text, one;
    an empty benchmark reports nothing.
    """
    keep = kept(keep, ("leaks", "__tkey"))
    leak = LEAK.format(benchmark.schema["item_id"].dataType.simpleString())
    items = cut(benchmark.where(F.col("text").isNotNull()).select("item_id", "text", F.xxhash64("item_id", "text").alias("ik")).dropDuplicates(["ik"]))
    seeds = seed_table(items.select("ik", "text"), coverage)
    ks = [r.k for r in seeds.select("k").distinct().orderBy("k").collect()]  # at most SEED
    rows = docs.select(*keep, F.xxhash64("text").alias("__tkey"))
    if not ks:
        return rows.drop("__tkey").withColumn("leaks", F.array().cast(leak))
    map_ = docs.sparkSession.sparkContext.broadcast(bit_map(seeds))

    def search(batches):
        bits = np.frombuffer(map_.value, np.uint8)
        low = np.uint64(len(bits) * 8 - 1)
        test = lambda x: bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1
        seen: set[int] = set()
        for b in batches:
            out = []
            for t, text in zip(b["tkey"], b["text"], strict=True):
                if t in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(t)
                ids = token_hashes(tokens(text))
                for k in ks:
                    h = window_hashes(ids, k)
                    h = h[test(h & low) == 1]
                    h = np.unique(h[test(h >> np.uint64(32) & low) == 1])
                    if len(h):
                        out.append((np.full(len(h), t, np.int64), h.view(np.int64)))
            if out:
                tkey, h = map(np.concatenate, zip(*out, strict=True))
                yield pd.DataFrame({"tkey": tkey, "h": h})

    src = python_batches(docs).where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("tkey"), "text")
    hits = src.mapInPandas(search, "tkey long, h long")
    table = seeds.select("ik", "h")
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        pairs = hits.join(F.broadcast(table), "h")
    else:
        table = table.select("ik", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        pairs = hits.withColumn("salt", F.pmod("tkey", F.lit(SALTS)).cast("int")).join(table, ["h", "salt"])
    pairs = cut(pairs.select("tkey", "ik").distinct())
    texts = src.join(_small(pairs.select("tkey").distinct()), "tkey", "left_semi").dropDuplicates(["tkey"])
    about = items.select("ik", "item_id", F.col("text").alias("item"))
    size = about.agg(F.coalesce(F.sum(F.octet_length("item") + 32), F.lit(0))).first()[0]
    about = F.broadcast(about) if size <= BROADCAST_BYTES else about
    both = pairs.join(texts, "tkey").join(about, "ik").select("tkey", "item_id", "text", "item")
    element = leak[len("array<struct<") : -2].partition(",")[2]
    schema = f"tkey long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, found struct<{element}>"

    def check(batches):
        last, words, hashes = None, [], None
        for b in batches:
            out = []
            for t, i, text, item in zip(b["tkey"], b["item_id"], b["text"], b["item"], strict=True):
                if t != last:
                    last, words = t, tokens(text)
                    hashes = token_hashes(words)
                if found := verified(words, tokens(item), coverage, hashes):
                    out.append((t, i, found))
            yield pd.DataFrame(out, columns=["tkey", "item_id", "found"])

    found = both.mapInPandas(check, schema)
    leaks = cut(found.groupBy(F.col("tkey").alias("__tkey")).agg(F.sort_array(F.collect_list(F.struct("item_id", "found.*"))).cast(leak).alias("leaks")))
    out = rows.join(_small(leaks), "__tkey", "left")
    return out.select(*keep, F.coalesce("leaks", F.array().cast(leak)).alias("leaks"))


def query(spark, sf_dir):
    """One row per document and item that it leaks."""
    from .common import documents

    found = annotate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("leaks") > 0)
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.item_tokens", "l.covered", "l.coverage", F.size("l.tiles").alias("n_tiles"))
