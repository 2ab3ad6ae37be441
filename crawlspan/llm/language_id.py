"""Language ID by segmentation-marginalised unigrams.

Each language has a probability per piece of a fixed public vocabulary. A word's probability is the sum
over all its segmentations into pieces, by the forward algorithm; a text's, the product over its words.
Probabilities are learned by expectation-maximisation (forward-backward) on a bounded, documented
sample of rows with a language (``sample_rows`` of each). Scoring keeps the vectors of words already
seen, within a size bound, and runs the forward algorithm over many new words of a length at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, learnable, python_batches

#: Rows of each language that probabilities are learned from, at most.
SAMPLE_ROWS = 150
ROUNDS = 3
#: Runs of letters up to this length are scored many at once; longer ones one by one, in logarithms, over the whole run.
TOGETHER = 24
#: Vectors of words that a worker keeps, and their length at most.
KEEP, KEEP_LENGTH = 300_000, 64
#: Weight of evidence spread over all pieces of a language.
SMOOTH = 0.05
UNKNOWN = 1e-7


@cache
def letters() -> re.Pattern:
    r"""A letter (\p{L}) and what follows of letters and their marks (\p{M}), as one character class that re matches fast."""
    import sys

    runs, kinds = {"L": [], "LM": []}, [unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)]
    for want, out in runs.items():
        inside = np.fromiter((k in want for k in kinds), bool, len(kinds))
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
        out += [f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return re.compile(f"[{''.join(runs['L'])}][{''.join(runs['LM'])}]*")


#: Below U+0300 there are no marks, and of numbers that aren't digits only these six.
FAR, NEAR = re.compile(r"[^\x00-\u02FF]"), re.compile("[^\\W\\d_²³¹¼½¾]+")


def runs_of(text: str) -> list[str]:
    text = text.lower()
    return (letters() if FAR.search(text) else NEAR).findall(text)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that consist of letters, lower-cased; word starts aren't marked."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if letters().fullmatch(p))


class Pieces:
    def __init__(self, vocab: list[str]):
        self.ids = {p: i for i, p in enumerate(vocab)}
        self.longest = max(map(len, vocab), default=1)
        self.none = len(vocab)  # any single letter outside the vocabulary
        self.size = len(vocab) + 2  # the last id: not a piece

    def lattice(self, words: list[str]) -> np.ndarray:
        """Ids [word, end, length] of all substrings of words of one length."""
        get, n, m = self.ids.get, len(words[0]), min(self.longest, len(words[0]))
        no, one = self.size - 1, self.none
        flat = [get(w[e - k : e], no if k > 1 else one) if k <= e else no for w in words for e in range(1, n + 1) for k in range(1, m + 1)]
        return np.array(flat, np.int32).reshape(len(words), n, m)

    def forward(self, words: list[str], prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha [length + 1][word, language] and the lattice."""
        ids = self.lattice(words)
        n, m = ids.shape[1:]
        alpha = np.zeros((n + 1, len(words), prob.shape[1]))
        alpha[0] = 1
        for e in range(1, n + 1):
            for k in range(1, min(e, m) + 1):
                alpha[e] += alpha[e - k] * prob[ids[:, e - 1, k - 1]]
        return alpha, ids

    def ids_at(self, run: str, end: int) -> list[int]:
        """Ids of the substrings of 1, 2 ... letters that end at ``end``."""
        get = self.ids.get
        return [get(run[end - k : end], self.size - 1 if k > 1 else self.none) for k in range(1, min(self.longest, end) + 1)]

    def log_forward(self, run: str, log_prob: np.ndarray) -> np.ndarray:
        """Log probability of a whole run in each language; only the last ``longest`` sums are held."""
        last = np.zeros((1, log_prob.shape[1]))  # those of the prefixes before, the nearest first
        for e in range(1, len(run) + 1):
            new = np.logaddexp.reduce(last + log_prob[self.ids_at(run, e)], axis=0)
            last = np.concatenate([new[None], last[: self.longest - 1]])
        return last[0]

    def log_counts(self, run: str, log_prob: np.ndarray, times: np.ndarray, seen: np.ndarray) -> None:
        """Add the expected counts of a run's pieces, ``times`` over, by forward and backward sums in logarithms."""
        n, ids = len(run), [self.ids_at(run, e) for e in range(1, len(run) + 1)]
        alpha, beta = np.full((n + 1, len(times)), -np.inf), np.full((n + 1, len(times)), -np.inf)
        alpha[0] = beta[n] = 0
        for e, at in enumerate(ids, 1):
            alpha[e] = np.logaddexp.reduce(alpha[e - len(at) : e][::-1] + log_prob[at], axis=0)
        for e in range(n, 0, -1):
            at = ids[e - 1]
            with np.errstate(invalid="ignore"):
                np.logaddexp.at(beta, np.arange(e - 1, e - len(at) - 1, -1), beta[e] + log_prob[at])
                np.add.at(seen, at, np.exp(alpha[e - len(at) : e][::-1] + log_prob[at] + beta[e] - alpha[n]) * times)


def by_length(words) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def logs(prob: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(prob)


def learn(texts: list[str], langs: list[str], vocab: list[str], rounds: int = ROUNDS) -> dict:
    pieces, names = Pieces(vocab), sorted(set(langs))
    counts = {name: Counter() for name in names}
    for t, name in zip(texts, langs, strict=True):
        counts[name].update(runs_of(t))
    prob = np.full((pieces.size, len(names)), 1.0 / max(1, pieces.size))
    prob[-1] = 0
    groups = by_length(sorted(set().union(*counts.values()))) if counts else {}
    for _ in range(rounds):
        seen = np.zeros_like(prob)
        for n, all_words in groups.items():
            if n > TOGETHER:
                log_prob = logs(prob)
                for w in all_words:
                    pieces.log_counts(w, log_prob, np.array([counts[name][w] for name in names], float), seen)
                continue
            for at in range(0, len(all_words), 20_000):
                words = all_words[at : at + 20_000]
                c = np.array([[counts[name][w] for name in names] for w in words], float)
                alpha, ids = pieces.forward(words, prob)
                beta = np.zeros_like(alpha)
                beta[n] = 1
                m = ids.shape[2]
                for s in range(n - 1, -1, -1):
                    for k in range(1, min(n - s, m) + 1):
                        beta[s] += beta[s + k] * prob[ids[:, s + k - 1, k - 1]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scale = np.where(alpha[n] > 0, c / alpha[n], 0)
                for e in range(1, n + 1):
                    for k in range(1, min(e, m) + 1):
                        i = ids[:, e - 1, k - 1]
                        np.add.at(seen, i, alpha[e - k] * prob[i] * beta[e] * scale)
        seen[-1] = 0
        total = seen.sum(0, keepdims=True)
        prob = (seen + SMOOTH * total / pieces.size + 1e-9) / (total * (1 + SMOOTH) + 1e-9 * pieces.size)
        prob = np.maximum(prob, UNKNOWN)
        prob[-1] = 0
    return {"names": names, "prob": prob.astype(np.float64), "vocab": vocab}


class Scorer:
    def __init__(self, model: dict):
        self.names, self.prob, self.pieces = model["names"], model["prob"], Pieces(model["vocab"])
        self.log_prob = logs(self.prob)
        self._clear()

    def _clear(self):
        self.row: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.names)))

    def learn_words(self, words: set[str]):
        for n, group in by_length(sorted(words)).items():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                # up to TOGETHER letters of at least UNKNOWN each can't come near the smallest double
                rows = np.log(self.pieces.forward(part, self.prob)[0][-1]) if n <= TOGETHER else np.array([self.pieces.log_forward(w, self.log_prob) for w in part])
                first = len(self.row)
                while first + len(part) > len(self.table):
                    self.table = np.r_[self.table, np.zeros_like(self.table)]
                self.table[first : first + len(part)] = rows
                self.row.update((w, first + i) for i, w in enumerate(part))

    def batch(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [runs_of(t) if isinstance(t, str) else [] for t in texts]
        if len(self.row) > KEEP:
            self._clear()
        new = {w for w in set().union(*words).difference(self.row) if len(w) <= KEEP_LENGTH} if words else set()
        if new and self.names:
            self.learn_words(new)
        lang, score = [], []
        get = self.row.get
        for w in words:
            if not w or not self.names:
                lang.append("und")
                score.append(0.0)
                continue
            at = np.fromiter((get(x, -1) for x in w), np.int64, len(w))
            z = self.table[at[at >= 0]].sum(0)
            for i in np.flatnonzero(at < 0).tolist():
                z = z + self.pieces.log_forward(w[i], self.log_prob)
            z = np.exp(z - z.max())
            best = int(z.argmax())
            lang.append(self.names[best])
            score.append(float(z[best] / z.sum()))
        return lang, score


_READY: dict[int, Scorer] = {}


def fit(docs: DataFrame, vocab_path: str | None = None, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Learn from text and non-null lang of rows that aren't held out."""
    if vocab_path is None:
        import public_tokenizers

        vocab_path = public_tokenizers.path("piece_bpe_32k.model")
    own = docs.where(F.col("lang").isNotNull() & learnable(F.col("doc_id"))).select("doc_id", "lang")
    rows = bounded_sample(docs, own, "lang", sample_rows).select("lang", "text").toPandas().sort_values(["lang", "text"], kind="stable")
    return learn(rows["text"].tolist(), rows["lang"].tolist(), vocabulary(vocab_path))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score (probability of lang_pred, all languages being as likely) per row.

    Whole texts are scored. Null text and text without a letter: 'und', 0. Without any learned language,
    every row is 'und'. Ties go to the first language by name. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    model_ = spark.sparkContext.broadcast(model)
    key = hash((tuple(model["names"]), model["prob"].tobytes()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        s = _READY.get(key)
        if s is None:
            _READY.clear()
            s = _READY[key] = Scorer(model_.value)
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                lang, score = s.batch(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "lang_pred": lang, "score": score})

    src = python_batches(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return src.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir):
    from .common import documents

    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
