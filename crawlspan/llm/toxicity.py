"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs (accented, Cyrillic, Greek, full-width letters) and digit
substitutions to one letter each, drops combining marks and invisible characters, and makes anything
else a space; words stand one space apart. Entries match from the start of a word, so inflected forms
count. Weights are log-odds learned from labelled rows; matches inside an exception phrase, which matches
whole words only, don't count. A logistic curve over the matched weight, plain and normalised by the
text's length, gives the score.

Learned on a bounded, documented sample (``sample_rows`` of each label). Counts of word beginnings are
aggregated in Spark; the driver gets the beginnings that tell toxic texts apart, which of them each sampled
text has, and two numbers a text for the curve.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, kept, learnable, python_batches

#: Labelled rows of either label that weights are learned from, at most.
SAMPLE_ROWS = 2500
THRESHOLD = 0.7
#: Entries with a default weight where labels say nothing.
BASE = (
    "idiot", "moron", "scum", "stupid", "worthless", "trash", "disgusting", "clown", "loser", "pathetic", "imbecile", "dumbass", "scumbag", "vermin", "retard",
    "asshole", "bastard", "bitch", "cretin", "dimwit", "halfwit", "jackass", "nitwit", "slut", "subhuman", "twat", "wanker", "whore",
)
BASE_WEIGHT = 4.0
#: Whole words inside which nothing counts, with and without a plural s.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash compactor", "clown fish", "clownfish", "circus clown", "clown car", "pond scum", "soap scum", "loser bracket", "losers bracket", "sore loser",
    "pathetic fallacy", "flame retardant", "fire retardant", "retardant", "retardation", "bastard sword", "bastard file", "vermin control",
)
HOMOGLYPHS = dict(zip("аевгкмнорстухісјԁѕһӏьαβεικνορτυχηωßıøđłħ", "aebrkmhopctyxicjdshibabeikvoptuxnwsiodih", strict=True))
DIGITS = dict(zip("0134578@$€", "oieastbase", strict=True))
PREFIX = (4, 10)
#: Word beginnings that a worker counts before it passes them on.
FLUSH = 300_000


class Fold(dict):
    """A table for str.translate that folds code points as they turn up. i, l and 1 fold together."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()[:1]
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):
            c = ""
        else:
            c = HOMOGLYPHS.get(c) or unicodedata.normalize("NFKD", c)[:1]
            c = DIGITS.get(c) or HOMOGLYPHS.get(c, c).lower()[:1]
            c = "i" if c == "l" else c if c.isalpha() else " "
        self[code] = c
        return c


FOLD = Fold()


def fold(text: str) -> str:
    """Folded words with one space before and after each."""
    return f" {' '.join(text.translate(FOLD).split())} "


def begin(words: Counter) -> Counter:
    """How often each word beginning, and each word of three letters, occurs."""
    out = Counter()
    for w, k in words.items():
        for n in (3,) if len(w) == 3 else range(PREFIX[0], min(len(w), PREFIX[1]) + 1):
            out[w[:n]] += k
    return out


class Lexicon:
    def __init__(self, entries: dict[str, float], curve: list[float]):
        self.entries, self.curve = entries, curve
        self.auto = ahocorasick.Automaton()
        for w, x in entries.items():
            self.auto.add_word(" " + w, (x, len(w) + 1))
        for phrase in EXCEPTIONS:
            for form in (fold(phrase), fold(phrase + "s")):
                self.auto.add_word(form, (-1.0, len(form)))
        self.auto.make_automaton()

    def features(self, folded: str) -> tuple[float, float]:
        """Log of the matched weight, plain and per 100 words. Of entries that match at one word, the heaviest counts."""
        hits = [(end - n + 1, end, x) for end, (x, n) in self.auto.iter(folded)]
        safe = sorted((a, b) for a, b, x in hits if x < 0)
        # reach[i]: where the exceptions that start up to the i-th end at most
        starts, reach = [a for a, _ in safe], []
        for _, b in safe:
            reach.append(max(b, reach[-1]) if reach else b)
        best: dict[int, float] = {}
        for a, b, x in hits:
            if x > 0 and not ((i := bisect_right(starts, a)) and reach[i - 1] >= b):
                best[a] = max(x, best.get(a, 0.0))
        total = sum(best.values())
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        a, b = self.features(fold(text)) if text else (0.0, 0.0)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def tally(batches):
    """(label, text) -> (beginning, label, texts that have it, occurrences) of a stretch of rows; '' counts all texts and words."""
    found: dict[tuple[str, int], list[int]] = {}

    def flush():
        rows = [(w, y, n, k) for (w, y), (n, k) in found.items()]
        found.clear()
        return pd.DataFrame(rows, columns=["w", "toxic", "texts", "times"])

    def add(w, y, k):
        got = found.setdefault((w, y), [0, 0])
        got[0] += 1
        got[1] += k

    for b in batches:
        for y, t in zip(b["toxic"], b["text"], strict=True):
            words = Counter(fold(t).split())
            add("", y, words.total())
            for w, k in begin(words).items():
                add(w, y, k)
            if len(found) > FLUSH:
                yield flush()
    yield flush()


def pick(good: dict[str, tuple[float, int]], has: list[list[str]], p: int, n: int) -> dict[str, float]:
    """Entries picked one by one, the one first that covers most toxic texts not yet covered beyond the clean texts that have it.

    good: beginning -> (log-odds, clean texts that have it); has: the beginnings of each toxic text.
    """
    out: dict[str, float] = {}
    left = [set(x) for x in has]
    cover = Counter(w for b in left for w in b)
    gain = lambda w: cover[w] / p - 2 * good[w][1] / n
    while cover:
        w = max(cover, key=lambda w: (gain(w), -len(w), w))
        if gain(w) < 3 / p:
            break
        out[w] = round(min(8.0, good[w][0]), 4)
        for b in left:
            if w in b:
                cover.subtract(b)
                b.clear()
        cover = +cover
    return out


def curve_of(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression by ridge-penalised Newton steps. x: rows of two features."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(3)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (y - q) - np.array([0.0, 0.3, 0.3]) * beta
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-6, 0.3, 0.3])
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return [round(float(c), 6) for c in beta]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Learn from labels (doc_id, toxic) of documents that aren't held out.

    Null labels are ignored; of conflicting labels of one id the higher counts. Entries are word beginnings
    e**2 times as frequent in toxic texts. With fewer than five texts of a label, the built-in entries stand.
    """
    own = labels.where(F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    rows = python_batches(bounded_sample(docs, own.where("toxic IN (0, 1)"), "toxic", sample_rows)).select("toxic", "text")
    entries, curve = {fold(w).strip(): BASE_WEIGHT for w in BASE}, [-4.0, 2.2, 0.6]
    counted = rows.mapInPandas(tally, "w string, toxic long, texts long, times long").groupBy("w").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col(c))), F.lit(0)).alias(f"{c}{y}") for c in ("texts", "times") for y in (0, 1)])
    whole = next(iter(counted.where("w = ''").collect()), None)
    p, n = (whole.texts1, whole.texts0) if whole else (0, 0)
    if p < 5 or n < 5:
        return {"entries": entries, "curve": curve}
    rate = F.log((F.col("times1") + 0.5) / F.lit(whole.times1 + 1.0)) - F.log((F.col("times0") + 0.5) / F.lit(whole.times0 + 1.0))
    tells = (F.col("rate") >= 2) & (F.col("texts1") >= 3) & (F.col("texts1") * n >= 3 * F.col("texts0") * p)
    base = sorted({w[: PREFIX[1]] for w in entries} | set(entries))
    found = counted.where("w <> ''").withColumn("rate", rate).where(tells | F.col("w").isin(base)).select("w", "rate", "texts0", "texts1", tells.alias("tells")).collect()
    good = {r.w: (r.rate, r.texts0) for r in found if r.tells}
    if good:
        words = docs.sparkSession.sparkContext.broadcast(frozenset(good))

        def which(batches):
            for b in batches:
                yield pd.DataFrame({"has": [sorted(words.value & begin(Counter(fold(t).split())).keys()) for t in b["text"]]})

        has = rows.where("toxic = 1").select("text").mapInPandas(which, "has array<string>").where(F.size("has") > 0)
        entries |= pick(good, sorted(list(r.has) for r in has.collect()), p, n)
    about = {r.w: r for r in found}
    for w in entries:
        r = about.get(w)
        if w not in good and r is not None and r.texts0 + r.texts1 >= 5:
            begins = about.get(w[: PREFIX[1]])
            entries[w] = round(max(0.0, min(BASE_WEIGHT, begins.rate if begins is not None else 0.0)), 4)
    entries = {w: x for w, x in entries.items() if x > 0}
    lexicon_ = docs.sparkSession.sparkContext.broadcast(entries)

    def features(batches):
        lexicon = Lexicon(lexicon_.value, curve)
        for b in batches:
            yield pd.DataFrame([(float(y), *lexicon.features(fold(t))) for y, t in zip(b["toxic"], b["text"], strict=True)], columns=["y", "a", "b"])

    xy = np.array(sorted(tuple(r) for r in rows.mapInPandas(features, "y double, a double, b double").collect()))
    return {"entries": entries, "curve": curve_of(xy[:, 1:], xy[:, 0])}


OWN = ("doc_id", "held_out", "score", "predicted")


def score_toxicity(docs: DataFrame, model: dict, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) per row, + the columns in keep that aren't named like these.

    Whole texts are scored. Null and empty texts have no match and get the curve's lowest score. Repeated
    rows give repeated results; an empty table gives none.
    """
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    keep = kept(keep, OWN)
    rows = docs.select("doc_id", *keep, held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias("_scored"))
    schema = rows.drop("_scored").withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches):
        lexicon = Lexicon(model_.value["entries"], model_.value["curve"])
        for b in batches:
            score = np.fromiter((lexicon.score(x if isinstance(x, str) else None) for x in b["_scored"]), float, len(b))
            out = b.drop(columns="_scored")
            out["score"] = score
            out["predicted"] = (score >= threshold).astype(np.int32)
            yield out

    return python_batches(rows).mapInPandas(run, schema)


def query(spark, sf_dir):
    from .common import documents

    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
