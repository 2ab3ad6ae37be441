"""Token counts by a finite-state tokenizer, compiled from a byte-level BPE vocabulary.

Two deterministic transducers in cascade:

* the splitter, over classes of characters (what it needs to look ahead is part of a character's class),
  emits a mark where a piece begins. Texts stand one after the other and are cut into chunks of ``CHUNK``
  characters; a chunk's state map (state before -> state after, from all states at once) is made for all
  chunks together, the maps are composed in a parallel prefix scan, and with the state that each
  chunk is entered in, its marks follow. Longer stretches than ``BLOCK`` go on with the state that they end in;
* per piece, a byte transducer whose transitions are annotated with emitted-token counts. After each
  prefix of a piece, BPE's segmentation of the prefix has one last token; a token t may follow a token s
  in a BPE segmentation exactly if BPE leaves the two apart in s+t. So the last token of each longer
  prefix follows from the last tokens within the longest suffix that begins some token, which is a
  finite state. States and transitions are compiled on demand and kept; so is, for a piece already
  seen, the whole path from the start state back to it with its count (both within a size bound).

Which characters are letters, numbers and white space is asked of the library's own splitter once, on the
driver, as its Unicode version decides.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, python_batches

LIMIT = 512
#: Characters of a chunk, and of a stretch that is held as arrays at once.
CHUNK, BLOCK = 64, 1 << 20
#: Kept pieces and transitions; beyond that, the tables start anew.
KEEP, MOVES = 800_000, 1_000_000
#: Pieces of up to 16 bytes are looked up in a table with 2**SLOTS places, many at once.
SLOTS = 20

OTHER, LETTER, NUMBER, WHITE = range(4)
#: Symbols: classes, apostrophes that begin a contraction of two or three characters, white space before
#: white space or the end, a space and another white space before anything else, the end of a text.
L, N, O, Q2, Q3, RUN, SPACE, LONE, END = range(9)
#: States: between pieces, in letters, numbers, others, white space, after a space, one or two characters before a contraction's end.
BETWEEN, IN_L, IN_N, IN_O, IN_W, AFTER, LAST1, LAST2 = range(8)


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """The splitter of byte-level BPE with 50,257 ids: next state and whether a piece begins, by state * 9 + symbol."""
    begin = {L: IN_L, N: IN_N, O: IN_O, Q2: LAST1, Q3: LAST2, RUN: IN_W, SPACE: AFTER, LONE: BETWEEN, END: BETWEEN}
    go, mark = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    go[:] = [begin[x] for x in range(9)]
    for state, symbols, to in ((IN_L, (L,), IN_L), (IN_N, (N,), IN_N), (IN_O, (O, Q2, Q3), IN_O), (IN_W, (RUN,), IN_W), (AFTER, (L,), IN_L), (AFTER, (N,), IN_N), (AFTER, (O, Q2, Q3), IN_O), (LAST2, (L,), LAST1), (LAST1, (L,), BETWEEN)):
        go[state, symbols], mark[state, symbols] = to, False
    return go.ravel(), mark.ravel()


GO, MARK = splitter()


@cache
def classes(spec: str) -> bytes:
    """The class of every code point, as the library's splitter joins it to a letter, a number or a sign."""
    from tokenizers import Tokenizer

    pre = Tokenizer.from_str(spec).pre_tokenizer
    out = np.full(0x110000, WHITE, np.uint8)
    left = np.r_[0:0xD800, 0xE000:0x110000]
    for sample, kind in (("!", OTHER), ("a", LETTER), ("1", NUMBER)):
        rest = []
        for part in np.array_split(left, max(1, len(left) // 20_000)):
            # units of three characters: a piece that begins at a unit's second one isn't of the sample's class
            starts = np.zeros(3 * len(part) + 1, bool)
            found = pre.pre_tokenize_str("".join(f"{sample}{chr(i)}\n" for i in part.tolist()))
            starts[[a for _, (a, _) in found]] = True
            joined = ~starts[1:-1:3]
            out[part[joined]] = kind
            rest.append(part[~joined])
        left = np.concatenate(rest)
    return out.tobytes()


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable bytes stand for themselves, the others are numbered from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, spec: str, kinds: bytes):
        d = json.loads(spec)
        back = byte_alphabet()
        raw = lambda s: bytes(back[c] for c in s)
        special = {a["content"] for a in d["added_tokens"]}
        self.vocab = {raw(t): i for t, i in d["model"]["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = sorted(special, key=len, reverse=True)
        self.special_rx = regex.compile("|".join(map(regex.escape, self.special))) if special else None
        self.begins = {t[:i] for t in self.vocab for i in range(1, len(t) + 1)}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.kinds = np.frombuffer(kinds, np.uint8)
        self.known = (np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.uint8), np.zeros(1 << SLOTS, np.int32))
        self._clear()

    def _clear(self):
        self.pieces: dict[bytes, int] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.start = self._state(b"", ((None, 0),))

    def _state(self, suffix: bytes, last: tuple) -> int:
        key = (suffix, last)
        if (i := self.ids.get(key)) is None:
            i = self.ids[key] = len(self.states)
            self.states.append(key)
        return i

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short byte string; only used to see whether two tokens stay apart."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, s: bytes, t: bytes) -> bool:
        if (r := self.follows.get((s, t))) is None:
            if len(self.follows) > KEEP:
                self.follows.clear()
            r = self.follows[s, t] = self.merge(s + t) == [s, t]
        return r

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition's next state and the number of tokens it adds.

        last[i]: the last token of the prefix that ends i bytes into the suffix, and how many tokens
        that prefix has more than the whole.
        """
        suffix, last = self.states[state]
        ext = suffix + bytes([byte])
        for i, (tok, rel) in enumerate(last):
            t = ext[i:]
            if t in self.vocab and (tok is None or self.may_follow(tok, t)):
                added = rel + 1
                break
        else:
            raise ValueError(f"byte {byte} isn't in the vocabulary")
        last = (*((a, r - added) for a, r in last), (t, 0))
        while ext and ext not in self.begins:
            ext, last = ext[1:], last[1:]
        return self._state(ext, last), added

    def piece(self, piece: bytes) -> int:
        """Tokens of one piece: the emitted counts along its path."""
        state, n = self.start, 0
        for b in piece:
            if (move := self.moves.get(state << 8 | b)) is None:
                move = self.moves[state << 8 | b] = self._compile(state, b)
            state, n = move[0], n + move[1]
        return n

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The splitter's symbols of code points. ends: places of the characters between texts, which are white space."""
        kind = self.kinds[points]
        out = np.array([O, L, N, RUN], np.uint8)[kind]
        white = kind == WHITE
        on = np.append(white[1:], True)
        on[ends[ends > 0] - 1] = True
        lone = white & ~on
        out[lone] = np.where(points[lone] == 32, SPACE, LONE)
        q = np.flatnonzero(points == 39)
        if len(q):
            after = np.append(points, [0, 0])
            a, b = after[q + 1], after[q + 2]
            out[q[np.isin(a, list(map(ord, "stmd")))]] = Q2
            out[q[(np.isin(a, list(map(ord, "rv"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]] = Q3
        out[ends] = END
        return out

    @staticmethod
    def marks(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Places where pieces begin, and the state after, from the state before."""
        n = len(symbols)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, END, np.uint8)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        # the map of each chunk: from every state at once
        maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
        for column in grid:
            maps = GO[maps * np.uint8(9) + column[:, None]]
        # their compositions from the first chunk on: a prefix scan that doubles its reach each time
        reach = 1
        while reach < rows:
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), 1)
            reach *= 2
        now = np.append(np.uint8(state), maps[:-1, state])
        found = np.empty((CHUNK, rows), bool)
        for k, column in enumerate(grid):
            at = now * np.uint8(9) + column
            found[k], now = MARK[at], GO[at]
            if k == (n - 1) % CHUNK:
                after = int(now[-1])
        return np.flatnonzero(found.T.ravel()[:n]), after

    def counts(self, data: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[first:last]."""
        size = last - first
        held = np.frombuffer(data + bytes(16), np.uint8)
        word = np.ndarray(len(data) + 9, "<u8", held, strides=(1,))
        low = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.arange(9, dtype=np.uint64)).clip(0, 63)
        low[0] = 0
        u = word[first] & low[np.minimum(size, 8)]
        v = word[first + np.minimum(size, 8)] & low[np.clip(size - 8, 0, 8)]
        with np.errstate(over="ignore"):
            slot = (mix(u * np.uint64(0x9E3779B97F4A7C15) + v + size.astype(np.uint64)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        ku, kv, ks, kn = self.known
        hit = (ks[slot] == size) & (ku[slot] == u) & (kv[slot] == v)
        out = np.where(hit, kn[slot], 0).astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            if len(self.pieces) > KEEP or len(self.moves) > MOVES:
                self._clear()
            pieces = self.pieces
            for i, a, z in zip(miss.tolist(), first[miss].tolist(), last[miss].tolist(), strict=True):
                p = data[a:z]
                if (n := pieces.get(p)) is None:
                    n = self.piece(p)
                    if len(p) < 4096:
                        pieces[p] = n
                out[i] = n
            short = miss[size[miss] <= 16]
            at, i = np.unique(slot[short], return_index=True)
            i = short[i]
            ku[at], kv[at], ks[at], kn[at] = u[i], v[i], size[i], out[i]
        return out

    def together(self, texts: list[str]) -> np.ndarray:
        """Tokens of each of some texts, none of which is longer than BLOCK."""
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts])[:-1] - 1
        at, _ = self.marks(self.symbols(points, ends), BETWEEN) if len(points) else (np.zeros(0, np.int64), 0)
        offset = offsets(points)
        inner = np.ones(len(points) + 1, bool)
        inner[ends] = False
        n = self.counts(joined.encode("utf-8", "surrogatepass"), offset[at], offset[np.append(at[1:], len(points))][: len(at)])
        n[~inner[at]] = 0
        return np.bincount(np.searchsorted(ends, at, "right"), weights=n, minlength=len(texts)).astype(np.int64)

    def long(self, text: str) -> int:
        """Tokens of a text, BLOCK by BLOCK; a piece that a block ends in goes on in the next."""
        total, state, begun, none = 0, BETWEEN, b"", np.zeros(0, np.int64)
        parts: list[bytes] = []
        for i in range(0, len(text), BLOCK):
            points = np.frombuffer(text[i : i + BLOCK + 2].encode("utf-32-le", "surrogatepass"), "<u4")
            symbols, points = self.symbols(points, none)[:BLOCK], points[:BLOCK]
            at, state = self.marks(symbols, state)
            data, offset = text[i : i + BLOCK].encode("utf-8", "surrogatepass"), offsets(points)
            if not len(at):
                parts.append(data)
                continue
            begun = b"".join((*parts, data[: offset[at[0]]]))
            total += self.piece(begun) if begun else 0
            total += int(self.counts(data, offset[at[:-1]], offset[at[1:]]).sum())
            parts = [data[offset[at[-1]] :]]
        return total + self.piece(b"".join(parts))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings inside a text are one token each."""
        of, units, out = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = [t]
            if self.special_rx and any(s in t for s in self.special):
                parts = self.special_rx.split(t)
                out[i] += len(parts) - 1
            for p in parts:
                if len(p) > BLOCK:
                    out[i] += self.long(p)
                elif p:
                    of.append(i)
                    units.append(p)
        done = 0
        while done < len(units):
            size, to = 0, done
            while to < len(units) and (to == done or size + len(units[to]) <= BLOCK):
                size += len(units[to])
                to += 1
            np.add.at(out, of[done:to], self.together(units[done:to]))
            done = to
        return out


def offsets(points: np.ndarray) -> np.ndarray:
    """Byte offsets of code points in UTF-8, and of their end."""
    width = np.ones(len(points) + 1, np.int64)
    width[0] = 0
    for least in (0x80, 0x800, 0x10000):
        width[1:] += points >= least
    return np.cumsum(width)


_READY: dict[int, Transducer] = {}


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of docs (doc_id, text); other columns are ignored.

    tokenizer: path of a byte-level BPE in the tokenizers library's JSON form (read once, by the driver).
    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results; an empty table, none.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    spec = docs.sparkSession.sparkContext.broadcast((text, classes(text)))
    key = hash(text)

    def run(batches):
        t = _READY.get(key)
        if t is None:
            t = _READY[key] = Transducer(*spec.value)
        for b in batches:
            n = t.count([x if isinstance(x, str) else "" for x in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": n, "over_limit": n > limit})

    kind = docs.schema["doc_id"].dataType.simpleString()
    src = python_batches(docs).select("doc_id", "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return src.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark, sf_dir):
    from .common import documents

    return count_tokens(documents(spark, sf_dir))
