"""N-gram Jaccard join by vertical partitioning.

The sets are distinct 5-word shingles, as 64-bit hashes. One global order of shingles (frequent ones
last, else by hash) gives candidates by prefix filtering: two sets of at least the threshold's overlap
share one of their first n - ceil(0.8 n) + 1 shingles. Candidates are then counted exactly: the hash
order is cut into fragments, overlaps are counted fragment by fragment, and summed per pair.

Rows with the same set are one class throughout. Runs of one shingle are streamed in order; of a run of
more than ``RUN`` classes, only the pairs with its first class (the one with fewest rare shingles) are
candidates at once. The rest of such runs is settled exactly afterwards: pairs are needed only between
classes that components still hold apart. The classes of such runs are joined again by themselves, with
their shingles ordered by exact counts among them, and a pair is compared only if the shingles from the
first one they share onwards are enough for the overlap.
Which shingles count as frequent only moves work around; results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii, python_batches, shingle_hashes, signed, word_hashes
from .components import components

WORDS = 5
#: Links: SIMILAR[1] * intersection >= SIMILAR[0] * union.
SIMILAR = (80, 100)
FRAGMENTS = 8
#: Bits of the map that candidates are compared by first, for sets of up to as many members.
BITS = 1024
#: Classes in a run whose pairs are all candidates.
RUN = 64
#: A shingle is frequent if blocks of BLOCK shingles that have it LOCAL times or more add up to FREQUENT.
BLOCK, LOCAL, FREQUENT = 2_000_000, 2, 32
FREQUENT_MOST = 2_000_000
BROADCAST_ROWS = 500_000


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(lower_ascii(text)), WORDS)) if isinstance(text, str) else np.zeros(0, np.uint64)


def identity(s: np.ndarray) -> int:
    """64-bit identity of a set of hashes; 0 for the empty set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = np.add.reduce(s * np.uint64(0x9E3779B97F4A7C15)) ^ np.bitwise_xor.reduce(s) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(len(s)) * np.uint64(0x165667B19E3779F9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return int((x ^ (x >> np.uint64(32))).astype(np.int64)) or 1


def needed(n: int | np.ndarray) -> int | np.ndarray:
    """The overlap that sets of together n shingles need."""
    a, b = SIMILAR
    return -(-a * n // (a + b))


def sql_needed(n: Column) -> Column:
    a, b = SIMILAR
    return F.ceil(n * a / F.lit(a + b)).cast("long") if (a, b) != (80, 100) else F.floor((n * 4 + 8) / 9).cast("long")


def bits(s: np.ndarray) -> bytes:
    """Parities of the set's hashes by their low bits; at least as many as the set has members."""
    size = max(BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Differing parities, a lower bound of the symmetric difference; the longer map is folded to the shorter."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(u) > len(v):
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def profile(batches, local: int = LOCAL):
    """kind 0: a row's set size, identity and bit map; kind 1: a shingle's count in a block, if it is locally frequent."""
    held, total = [], 0

    def flush():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h, n = signed(h[n >= local]), n[n >= local]
        return pd.DataFrame({"kind": 1, "doc_id": None, "tkey": 0, "n": n, "a": h, "bits": None})

    for b in batches:
        sets = [shingle_set(t) for t in b["text"]]
        yield pd.DataFrame({"kind": 0, "doc_id": b["doc_id"], "tkey": b["tkey"], "n": [len(s) for s in sets], "a": [identity(s) for s in sets], "bits": [bits(s) if len(s) else None for s in sets]})
        held += [s for s in sets if len(s)]
        total += sum(map(len, sets))
        if total >= BLOCK:
            yield flush()
            held, total = [], 0
    if held:
        yield flush()


def prefixes(frequent):
    def run(batches):
        hot = frequent.value
        seen: set[int] = set()
        for b in batches:
            out = []
            for t in b["text"]:
                s = shingle_set(t)
                if not len(s) or (a := identity(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(a)
                n = len(s)
                common = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(n, bool)
                rare = int(n - common.sum())
                p = n - int(-(-SIMILAR[0] * n // SIMILAR[1])) + 1
                first = np.concatenate([s[~common], s[common]])[:p]
                # own: how many of the set's shingles a pair of this run can share at most
                own = np.where(np.arange(len(first)) < rare, n, n - rare)
                keep = own >= -(-SIMILAR[0] * n // SIMILAR[1])
                out.append((signed(first[keep]), np.full(keep.sum(), a, np.int64), np.full(keep.sum(), n, np.int32), own[keep].astype(np.int32)))
            if out:
                key, a, n, own = map(np.concatenate, zip(*out, strict=True))
                yield pd.DataFrame({"key": key, "a": a, "n": n, "own": own, "rare": n - own})

    return run


def runs(batches, run: int = RUN):
    """Rows sorted by key, then fewest rare shingles. kind 0: candidate pairs (a < b); kind 1: the rows (a, key) of long runs."""

    def pairs(lo, hi):
        (a, n, own), (b, m, other) = lo, hi
        need = needed(n.astype(np.int64) + m)
        ok = (np.minimum(own, other) >= need) & (a != b)
        a, b, n, m = a[ok], b[ok], n[ok], m[ok]
        swap = a > b
        return np.where(swap, b, a), np.where(swap, a, b), np.where(swap, m, n), np.where(swap, n, m)

    leader = None  # of the long run that goes on: key, a, n, own
    rest = None

    def settle(d: pd.DataFrame, last: bool):
        nonlocal leader, rest
        key, a, n, own = (d[c].to_numpy() for c in ("key", "a", "n", "own"))
        out = []
        if not len(key):
            return out
        new = np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1])]
        key, a, n, own = key[new], a[new], n[new], own[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        if leader is not None and key[0] != leader[0]:
            leader = None
        end = len(key)
        goes_on = leader is not None
        if not last and size[-1] <= run and not (goes_on and len(start) == 1):
            end = start[-1]  # wait for the rest of the last run
        rest = pd.DataFrame({"key": key[end:], "a": a[end:], "n": n[end:], "own": own[end:], "rare": 0})
        key, a, n, own = key[:end], a[:end], n[:end], own[:end]
        if not end:
            return out
        start, size = start[start < end], size[start < end]
        long = size > run
        long[0] |= goes_on
        of = np.repeat(np.arange(len(start)), size)
        at = np.arange(end) - start[of]
        is_long = long[of]
        for lag in range(1, int(min(run, size[~long].max(initial=0)))):
            i = np.flatnonzero((at >= lag) & ~is_long)
            if not len(i):
                break
            out.append(pairs((a[i - lag], n[i - lag], own[i - lag]), (a[i], n[i], own[i])))
        if long.any():
            first = start[of]
            la, ln, lo = a[first], n[first], own[first]
            if goes_on:
                mine = of == 0
                la, ln, lo = np.where(mine, leader[1], la), np.where(mine, leader[2], ln), np.where(mine, leader[3], lo)
            i = np.flatnonzero(is_long)
            out.append(pairs((la[i], ln[i], lo[i]), (a[i], n[i], own[i])))
            rows.append((a[i], key[i], n[i], own[i]))
        if not last and not len(rest) and long[-1]:
            if not (goes_on and len(start) == 1):
                leader = (key[-1], a[start[-1]], n[start[-1]], own[start[-1]])
        return out

    def frame(kind, a, b, n, m):
        return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "a": a, "b": b, "n": n.astype(np.int32), "m": m.astype(np.int32)})

    for b in batches:
        rows: list = []
        out = settle(pd.concat([rest, b]) if rest is not None and len(rest) else b, False)
        if out:
            yield frame(0, *map(np.concatenate, zip(*out, strict=True))).drop_duplicates()
        if rows:
            yield frame(1, *map(np.concatenate, zip(*rows, strict=True)))
    if rest is not None and len(rest):
        rows = []
        out = settle(rest, True)
        if out:
            yield frame(0, *map(np.concatenate, zip(*out, strict=True))).drop_duplicates()
        if rows:
            yield frame(1, *map(np.concatenate, zip(*rows, strict=True)))


def close(batches):
    for b in batches:
        total = b["n"].to_numpy(np.int64) + b["m"].to_numpy(np.int64)
        differ = np.array([differing(x, y) for x, y in zip(b["bits_a"], b["bits_b"], strict=True)], np.int64)
        yield b.loc[differ <= total - 2 * needed(total), ["a", "b", "n", "m"]]


def fragments(batches):
    width = 64 - (FRAGMENTS - 1).bit_length()
    for b in batches:
        out = []
        for t in b["text"]:
            s = shingle_set(t)
            if not len(s):
                continue
            a = identity(s)
            f = (s >> np.uint64(width)).astype(np.int64)
            edge = np.searchsorted(f, np.arange(FRAGMENTS + 1))
            out += [(a, i, s[edge[i] : edge[i + 1]].tobytes()) for i in range(FRAGMENTS) if edge[i] < edge[i + 1]]
        yield pd.DataFrame(out, columns=["a", "f", "part"])


def members(batches):
    """Texts -> one row (identity and size of the set, shingle) for each shingle of their sets."""
    for b in batches:
        sets = [s for s in map(shingle_set, b["text"]) if len(s)]
        if sets:
            size = np.array([len(s) for s in sets], np.int32)
            yield pd.DataFrame({"a": np.repeat([identity(s) for s in sets], size), "n": np.repeat(size, size), "key": signed(np.concatenate(sets))})


def overlaps(batches):
    for b in batches:
        n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(b["part_a"], b["part_b"], strict=True)]
        yield pd.DataFrame({"a": b["a"], "b": b["b"], "n": b["n"], "m": b["m"], "shared": np.array(n, np.int64)})


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Join:
    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.src = python_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("tkey"))
        run, local = RUN, LOCAL  # as arguments, so that workers have them as they are here
        got = cut(self.src.mapInPandas(lambda b: profile(b, local), f"kind int, doc_id {kind}, tkey long, n long, a long, bits binary"))
        self.rows = got.where("kind = 0").select("doc_id", "tkey", "n", "a")
        self.maps = got.where("kind = 0 and n > 0").groupBy("a").agg(F.first("bits").alias("bits"), F.min("tkey").alias("tkey"))
        # at most the mean set size times blocks' share: see README for its bound
        hot = got.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "a").limit(FREQUENT_MOST).select("a")
        hot = np.sort(hot.toArrow().column(0).to_numpy().view(np.uint64))  # as Arrow: no object per row on the driver
        keys = self.src.select("text").where(F.col("text").isNotNull()).mapInPandas(prefixes(spark.sparkContext.broadcast(hot)), "key long, a long, n int, own int, rare int")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = keys.repartition(parts, "key").sortWithinPartitions("key", "rare", "a").mapInPandas(lambda b: runs(b, run), "kind int, a long, b long, n int, m int")
        self.found = cut(found.distinct())
        self.long = self.found.where("kind = 1").select("a", F.col("b").alias("key"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose bit maps differ in no more places than linked sets can."""
        left = self.maps.select("a", F.col("bits").alias("bits_a"))
        right = self.maps.select(F.col("a").alias("b"), F.col("bits").alias("bits_b"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "bits_a", "bits_b").mapInPandas(close, "a long, b long, n int, m int")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs that link, by overlaps counted per fragment and summed per pair."""
        ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
        texts = self.maps.join(ids, "a").select("tkey").distinct()
        parts = cut(self.src.join(_small(cut(texts)), "tkey", "left_semi").select("text").mapInPandas(fragments, "a long, f int, part binary").dropDuplicates(["a", "f"]))
        both = pairs.join(parts.withColumnRenamed("part", "part_a"), "a").join(parts.select(F.col("a").alias("b"), "f", F.col("part").alias("part_b")), ["b", "f"])
        counted = both.select("a", "b", "n", "m", "part_a", "part_b").mapInPandas(overlaps, "a long, b long, n int, m int, shared long")
        sums = counted.groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
        return sums.where(F.col("shared") >= sql_needed(F.col("n") + F.col("m"))).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def apart(self, roots: DataFrame) -> DataFrame:
        """Pairs of classes of long runs that components hold apart and that may link.

        Two classes of a long run that link are both among its rows, so the join is done again on these
        alone, with their shingles ordered by exact counts among them: what a long run's texts have in
        common comes last, and a run holds classes that agree on their rarest shared shingles.
        """
        runs_ = self.long.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        open_ = runs_.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        ids = cut(runs_.join(open_, "key", "left_semi").select("a", "root").distinct())
        texts = self.maps.join(ids, "a").select("tkey")
        sets = self.src.join(_small(cut(texts)), "tkey", "left_semi").dropDuplicates(["tkey"]).select("text").mapInPandas(members, "a long, n int, key long")
        # a shingle that one class has links nothing; its place in the order is before all others
        shared = sets.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("times > 1")
        shared = shared.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy("times", "key")))
        # left: how many shingles two classes can share at most if this is the first they share
        left = (F.count(F.lit(1)).over(Window.partitionBy("a")) - F.col("place") + 1).cast("int")
        keys = shared.select("key", "a", "n", left.alias("left")).where(F.col("left") * SIMILAR[1] >= F.col("n") * SIMILAR[0])
        keys = cut(keys).join(ids.select("a", "root"), "a")
        by = keys.groupBy("key", "root").count()
        main = by.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        keys = cut(keys.join(main, "key"))
        few = keys.where("root <> main").select("key", F.col("a").alias("x"), F.col("n").alias("n_x"), F.col("left").alias("left_x"), F.col("root").alias("root_x"))
        total = F.col("n") + F.col("n_x")
        pairs = few.join(keys, "key").where((F.col("root") != F.col("root_x")) & (F.least("left", "left_x") >= sql_needed(total)) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("x"))))
        low, high = F.struct(F.col("a").alias("a"), F.col("n").alias("n")), F.struct(F.col("x").alias("a"), F.col("n_x").alias("n"))
        pairs = pairs.select(F.least(low, high).alias("l"), F.greatest(low, high).alias("h"))
        return pairs.select(F.col("l.a").alias("a"), F.col("h.a").alias("b"), F.col("l.n").alias("n"), F.col("h.n").alias("m")).distinct()

    def classes(self) -> DataFrame:
        """(a, root) of the classes that link to others."""
        edges = cut(self.links(cut(self.near(self.found.where("kind = 0").select("a", "b", "n", "m")))))
        if self.long.isEmpty():
            return components(edges)
        roots = cut(components(edges))
        more = cut(self.near(self.apart(roots)))
        if more.isEmpty():
            return roots.select("node", "root")
        return components(edges.unionByName(self.links(more)))

    def result(self) -> DataFrame:
        roots = cut(self.classes()).select(F.col("node").alias("a"), "root")
        rows = self.rows.join(roots, "a", "left").withColumn("root", F.coalesce("root", "a"))
        first = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "tkey")).alias("stays"))
        first = cut(first)
        rows = rows.join(first, "root", "left")
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"), "tkey", F.when(F.col("n") > 0, F.struct("doc_id", "tkey") == F.col("stays")).otherwise(True).alias("stays"))


def join_near(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row.

    Null, empty and blank texts have no shingles and link with nothing. Fewer than five words are one
    shingle. Rows with the same set link, repeated rows too. component_id is the smallest doc_id that
    links reach; null ids are passed over (null only if no member has an id). Empty input gives no rows.
    """
    return Join(docs).result().select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that a smaller id of their component stands for. Rows repeated with the same id and text all stay."""
    gone = Join(docs).result().where("not stays").select("doc_id", "tkey").distinct()
    gone = _small(cut(gone)).alias("g")
    rows = docs.withColumn("_tkey", F.xxhash64("text")).alias("d")
    return rows.join(gone, F.expr("d.doc_id <=> g.doc_id and d._tkey = g.tkey"), "left_anti").drop("_tkey")


def query(spark, sf_dir):
    from .common import documents

    return join_near(documents(spark, sf_dir))


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
d AS (SELECT DISTINCT doc_id, sh FROM s),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM d x JOIN d y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
