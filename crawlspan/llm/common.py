"""Helpers the operators share: cutting lineage, word patterns, hashing, learned splits."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: ``checkpoint()`` into the folder that spark.checkpoint.dir names, shared by all executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    # without constraints: those a checkpoint keeps may name columns that later unions can't resolve
    key = "spark.sql.constraintPropagation.enabled"
    was = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, was)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local session, whose executors are this process, may go without."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="crawlspan-ckpt-")


def kept(keep: tuple[str, ...], own: tuple[str, ...]) -> tuple[str, ...]:
    """The columns to carry along, without those that an operator returns itself: of equal names its own column stands."""
    taken = {c.lower() for c in own}
    return tuple(dict.fromkeys(c for c in keep if c.lower() not in taken))


#: Rows and bytes of an Arrow batch that goes to Python: rows hold whole documents.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20


def python_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded by BATCH_ROWS and BATCH_BYTES (a longer text is a batch alone) if they are still at Spark's default of 10,000 rows."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(rows) == "10000":
        df.sparkSession.conf.set(rows, str(BATCH_ROWS))
        df.sparkSession.conf.set(size, str(BATCH_BYTES))
    return df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3, is 1. A null id is never held out (and never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= MIX1
    h ^= h >> np.uint64(27)
    h *= MIX2
    h ^= h >> np.uint64(31)
    return h


_POW: dict[str, np.ndarray] = {}
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_POW.get("p", ()))
    if have < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            p = np.ones(size, np.uint64)
            q = np.ones(size, np.uint64)
            inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
            np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)], out=p)
            np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, inv, np.uint64)], out=q)
        _POW["p"], _POW["q"] = p, q
    return _POW["p"], _POW["q"]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    w = np.empty(len(data) + 2, bool)
    w[0] = w[-1] = False
    np.logical_not(_SPACE[data], out=w[1:-1])
    edge = np.flatnonzero(w[1:] != w[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, from one prefix sum over the bytes: no loop over words."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * p[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def lower_ascii(text: str) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in text order; with fewer than k words, one for the whole sequence."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, np.uint64(width), np.uint64)
        for i in range(width):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : n - width + 1 + i])
    return h


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def bounded_sample(docs: DataFrame, rows: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` ids of each label: those with the smallest hash of their id.

    rows: (doc_id, label). One aggregate counts the labels; a second scan keeps the ids under each label's
    hash bound, which leaves about the rows wanted, so no task ever holds more than a few times ``most``
    rows of a label, and the driver none. Of an id's labels the smallest counts, of its texts too. The
    result is written to the checkpoint folder, as learners read it more than once.
    """
    ids = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    h = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))
    counts = cut(ids.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    counts = F.broadcast(counts) if counts.limit(SAMPLE_BROADCAST + 1).count() <= SAMPLE_BROADCAST else counts
    bound = F.least(F.lit(1.0), 1.5 * (most + 20) / F.col("n")) * F.lit(2.0**64) - F.lit(2.0**63)
    near = ids.withColumn("h", h).join(counts, label).where(F.col("h").cast("double") <= bound)
    place = F.row_number().over(Window.partitionBy(label).orderBy("h", "doc_id"))
    picked = cut(near.withColumn("place", place).where(F.col("place") <= most).select("doc_id", label))
    small = F.broadcast(picked) if picked.limit(SAMPLE_BROADCAST + 1).count() <= SAMPLE_BROADCAST else picked
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(small, "doc_id")
    return cut(texts.groupBy("doc_id", label).agg(F.min("text").alias("text")))


#: Sampled ids that are broadcast, at most; beyond (very many labels), they are joined by a shuffle.
SAMPLE_BROADCAST = 200_000
