"""Each operator against brute force on small fixtures, and on its edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlspan.llm import common, components, decontaminate, html_extract, language_id, line_dedup, mixing, ngram_join, substring_dedup, token_counts, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame(rows, schema)


def prose(r, n, words=None):
    return " ".join(r.choice(words or [f"w{i}" for i in range(400)]) for _ in range(n))


# hashing


def test_word_hashes_follow_words():
    r = random.Random(1)
    texts = ["".join(r.choice("ab \t\né漢") for _ in range(r.randint(0, 40))) for _ in range(300)]
    seen = {}
    for t in texts:
        words = WORD.findall(t)
        h = common.word_hashes(np.frombuffer(t.encode(), np.uint8)).tolist()
        assert len(h) == len(words)
        for w, x in zip(words, h, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# op1


def all_segmentations(word, prob):
    if not word:
        return 1.0
    return sum(prob.get(word[:k], 0.0) * all_segmentations(word[k:], prob) for k in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    vocab = ["a", "ab", "b", "ba", "bab"]
    p = language_id.Pieces(vocab)
    prob = np.random.default_rng(0).random((p.size, 2))
    prob[-1] = 0
    for w in ("abab", "bbab", "aaaa"):
        alpha, _ = p.forward([w], prob)
        for lang in (0, 1):
            assert alpha[-1][0, lang] == pytest.approx(all_segmentations(w, {v: prob[i, lang] for v, i in p.ids.items()}))


def test_language_id(spark, edge, nothing, data):
    docs = common.documents(spark, data)
    out = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)
    got = language_id.identify(edge, language_id.fit(edge, sample_rows=5)).collect()
    assert len(got) == 9 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 6)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(nothing, language_id.fit(nothing)).count() == 0


def test_long_runs_are_scored_whole():
    vocab = ["a", "ab", "b", "ba", "bab"]
    p = language_id.Pieces(vocab)
    prob = np.random.default_rng(1).random((p.size, 2))
    prob[-1] = 0
    run = "abbab" * 12
    alpha, _ = p.forward([run], prob)
    assert p.log_forward(run, language_id.logs(prob)) == pytest.approx(np.log(alpha[-1][0]))
    seen = np.zeros_like(prob)
    p.log_counts("abab", language_id.logs(prob), np.array([1.0, 2.0]), seen)

    def segmentations(w):
        return [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in p.ids for rest in segmentations(w[k:])]

    for lang, times in ((0, 1.0), (1, 2.0)):
        weight = [np.prod([prob[p.ids[x], lang] for x in s]) for s in segmentations("abab")]
        for v, i in p.ids.items():
            assert seen[i, lang] == pytest.approx(times * sum(w * s.count(v) for w, s in zip(weight, segmentations("abab"), strict=True)) / sum(weight))
    texts = ["ab" * 400, "ba" * 30 + " ab", "abb " * 20, "bba " * 20]
    s = language_id.Scorer(language_id.learn(texts, ["x", "y", "x", "y"], vocab))
    lang, score = s.batch(["ab" * 50_000, "² ½ Ⅷ 12", "न्दी", None])
    assert lang[1] == lang[3] == "und" and lang[0] != "und" and lang[2] != "und" and score[0] > 0.5


def test_letter_runs():
    import unicodedata

    r = random.Random(21)
    for _ in range(300):
        t = "".join(r.choice(["a", "é", "²", "½", "Ⅷ", "7", "_", " ", "字", "न", "्", "e\u0301", "İ"]) for _ in range(r.randint(0, 12)))
        want, run = [], ""
        for c in t.lower() + " ":
            k = unicodedata.category(c)[0]
            if k == "L" or k == "M" and run:
                run += c
            elif run:
                want, run = [*want, run], ""
        assert language_id.runs_of(t) == want, t


def test_held_out_rows_are_never_learned_from(spark):
    import zlib

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = frame(spark, [(i, "hello there", "en", None) for i in ids])
    assert language_id.fit(docs)["names"] == []
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    assert set(toxicity.fit(docs, labels)["entries"]) == {toxicity.fold(w).strip() for w in toxicity.BASE}


# op2


def test_tokens_match_library(monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    t = token_counts.Transducer(spec, token_counts.classes(spec))
    r = random.Random(5)
    bits = ["the", "ation", "aaaa", "      ", "<|endoftext|>", "-----", "\n\n", "ÃÂ", "999", " 's", "'ll", " ", "\x85", "\x1c", "漢字", "😀", "é", " ", "\t", "½", "Ⅷ", "́", "\x00"]
    bits += ["'re", "'r", "'l", "'t", "'ve", "'"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(600)] + ["x" * 300, "x " * 300]
    # every code point, between a letter, a digit, a sign and spaces
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts += ["".join(f"a{chr(i)}1{chr(i)}!{chr(i)} {chr(i)}\n" for i in points[at : at + 500]) for at in range(0, len(points), 500)]
    want = [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert t.count(texts).tolist() == want
    for chunk, block in ((5, 1 << 20), (3, 17), (64, 1)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "BLOCK", block)
        assert t.count(texts[:602]).tolist() == want[:602]


def test_token_counts(spark, edge, nothing):
    got = {r.doc_id: r for r in token_counts.count_tokens(edge).collect()}
    assert (got[1].n_bytes, got[1].n_tokens, got[2].n_tokens) == (0, 0, 0) and got[7].n_bytes == 6 and got[8].over_limit and got[8].n_tokens == 30_001
    assert token_counts.count_tokens(nothing).count() == 0


# op3


def plain_tiles(doc, item, least):
    """Greedy string tiling, straight from its definition."""
    md, mi, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in md and j + n not in mi:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return out
        n, i, j = best
        md |= set(range(i, i + n))
        mi |= set(range(j, j + n))
        out.append(best)


def test_tiles_cover_what_plain_tiling_covers():
    r = random.Random(2)
    for _ in range(150):
        item = [r.randrange(30) for _ in range(r.randint(6, 25))]
        k = r.randint(2, len(item) - 2)
        doc = [r.randrange(30) for _ in range(10)] + item[k:] + [99] + item[:k] + [r.randrange(30) for _ in range(5)]
        got = decontaminate.tile(doc, item, 3)
        assert all(doc[i : i + n] == item[j : j + n] for i, j, n in got)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got) == len({x for _, j, n in got for x in range(j, j + n)})
        assert abs(sum(n for *_, n in got) - sum(n for n, *_ in plain_tiles(doc, item, 3))) <= 3


def test_decontamination(spark, edge, nothing, monkeypatch):
    r = random.Random(3)
    item = prose(r, 40).split()
    whole, half = " ".join(item), " ".join(item[:18])
    swapped = " ".join(item[20:] + ["x"] + item[:20])
    docs = frame(spark, [(1, prose(r, 200) + " " + whole.upper() + "! " + prose(r, 50), None, None), (2, prose(r, 300), None, None), (3, f"{prose(r, 20)} {swapped}", None, None), (4, half, None, None)])
    bench = spark.createDataFrame([(7, whole), (8, None), (9, ""), (10, "zz yy")], "item_id long, text string")
    want = {(1, 7), (3, 7)}
    for rows in (500_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        got = decontaminate.annotate(docs, bench).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.coverage").collect()
        assert {(x.doc_id, x.item_id) for x in got} == want
    assert decontaminate.annotate(edge, bench).count() == 9
    assert decontaminate.annotate(nothing, bench).count() == 0
    assert decontaminate.annotate(docs, bench.limit(0)).where(F.size("leaks") > 0).count() == 0


def plain_leaks(text, item, coverage=0.8):
    """Tiles over the whole document and item, without seeds looked up before."""
    doc, item = decontaminate.tokens(text or ""), decontaminate.tokens(item or "")
    return bool(item) and sum(n for n, *_ in plain_tiles(doc, item, min(5, len(item)))) >= coverage * len(item)


def test_seed_join_finds_what_plain_tiling_finds(spark):
    """Items that share common passages, short ones, reordered and partial copies, ideographs."""
    r = random.Random(22)
    common = prose(r, 9)
    items = [f"{common} {prose(r, r.randint(3, 25))}" for _ in range(12)] + [prose(r, n) for n in (1, 2, 4, 5, 6, 12)] + ["一二三四五六七八九十", "w1 w1 w1 w1 w1 w1 w1 w1"]
    texts = []
    for _ in range(120):
        w = r.choice(items).split()
        if r.random() < 0.5:
            k = r.randint(0, len(w))
            w = w[k:] + ["zz"] * r.randint(0, 1) + w[:k]
        if r.random() < 0.4:
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join([prose(r, r.randint(0, 30)), *w, prose(r, r.randint(0, 30))]))
    texts += ["序六七八九十のあと一二三四五。", None, "", prose(r, 200), common]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.annotate(docs, bench).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id").collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if plain_leaks(t, item)}


# op4


def plain_components(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)})) if t else []
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize(("run", "local", "frequent"), [(64, 2, 32), (3, 2, 4), (3, 10**9, 10**9)])
def test_join_matches_all_pairs(spark, monkeypatch, run, local, frequent):
    """Also with runs cut very short, and with or without frequent shingles told apart."""
    for k, v in (("RUN", run), ("LOCAL", local), ("FREQUENT", frequent)):
        monkeypatch.setattr(ngram_join, k, v)
    r = random.Random(run + local % 97)
    line = prose(r, 30)
    texts = {}
    for base in range(12):
        words = prose(r, r.choice([40, 120])).split()
        for _ in range(r.choice([1, 2, 14])):
            w = list(words)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randrange(9)}"
            texts[len(texts) + 1] = " ".join(w) + (f" {line}" if base % 2 else "")
    texts |= {900: None, 901: "", 902: "one two", 903: "ONE two", 904: "one two three"}
    df = frame(spark, [(d, t, None, None) for d, t in texts.items()])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join_near(df).collect()}
    assert got == plain_components(texts)


def test_long_runs_that_stay_apart_are_settled_without_all_pairs(spark, monkeypatch):
    """Texts with a passage in common that no block shows to be frequent; a few link with one of the others."""
    for k, v in (("RUN", 8), ("LOCAL", 10**9)):
        monkeypatch.setattr(ngram_join, k, v)
    r = random.Random(11)
    common = prose(r, 40)
    own = [[f"{i}w{k}" for k in range(60)] for i in range(150)]
    texts = {i: f"{' '.join(w)} {common}" for i, w in enumerate(own)}
    for i in range(0, 150, 10):
        w = list(own[i])
        w[30] = "changed"
        texts[1000 + i] = f"{' '.join(w)} {common}"
    near, compared = ngram_join.Join.near, []
    monkeypatch.setattr(ngram_join.Join, "near", lambda self, pairs: compared.append(pairs.count()) or near(self, pairs))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join_near(frame(spark, [(d, t, None, None) for d, t in texts.items()])).collect()}
    assert got == plain_components(texts)
    assert len(compared) == 2 and compared[1] <= 2 * len(texts)


def test_runs_pair_up_everything_short_and_leaders_of_long():
    import pandas as pd

    key = np.repeat([5, 6, 7], [3, ngram_join.RUN + 40, 1])
    n = len(key)
    f = pd.DataFrame({"key": key, "a": np.arange(n), "n": 100, "own": 100, "rare": 0})
    for step in (7, 64, 10_000):
        out = pd.concat(list(ngram_join.runs(f.iloc[i : i + step] for i in range(0, n, step))))
        pairs = set(map(tuple, out[out.kind == 0][["a", "b"]].to_numpy().tolist()))
        assert {(0, 1), (0, 2), (1, 2)} <= pairs and {(3, 3 + i) for i in range(1, ngram_join.RUN + 40)} <= pairs
        assert set(out[out.kind == 1].a) == set(range(3, 3 + ngram_join.RUN + 40))


def test_join_edges(spark, edge, nothing):
    got = ngram_join.join_near(edge).collect()
    assert sorted((r.doc_id or 0, r.n_shingles) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (6, 1), (7, 1), (8, 1)]
    assert ngram_join.join_near(nothing).count() == 0
    assert ngram_join.one_of_each(edge).count() == 9


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: find(x) for x in root}


# op5


def test_mix_spends_each_target(spark, edge, nothing):
    r = random.Random(6)
    rows = [(i, prose(r, r.randint(0, 60)), None, r.choice(["a", "b", "c", "d", None])) for i in range(400)] + [(1000, prose(r, 900), None, "e")]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    by = {}
    for x in got:
        assert 0 <= x.taken <= 3 * x.size
        by.setdefault((x.source, x.source_size, x.target), []).append(x)
    total = sum(x.size for x in got)
    assert sum(t for _, _, t in by) == pytest.approx(total)
    for (_, size, target), xs in by.items():
        assert sum(x.size for x in xs) == size and target <= 3 * size + 1e-9 and sum(x.taken for x in xs) == int(target + 1e-9)
    again = mixing.mix_sources(frame(spark, rows[::-1])).collect()
    assert sorted((x.doc_id, x.taken) for x in again) == sorted((x.doc_id, x.taken) for x in got)
    assert mixing.mix_sources(edge).count() == 9 and mixing.mix_sources(nothing).count() == 0


def test_ranges_don_t_change_the_mix(spark, monkeypatch):
    r = random.Random(7)
    df = frame(spark, [(i, prose(r, r.randint(0, 20)), None, "ab"[i % 2]) for i in range(300)])
    one = sorted((x.doc_id, x.taken) for x in mixing.mix_sources(df).collect())
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 7)
    assert sorted((x.doc_id, x.taken) for x in mixing.mix_sources(df).collect()) == one


# op6


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    vecs = [rng.standard_normal(40).tolist() for _ in range(300)]
    vecs += [vecs[0]] * 30 + [None, [None] * 40, [1.0] * 7]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, vector array<double>")
    got = topk.top_k(rows, rows.where("id % 20 = 0"), 10).collect()
    code = [None if v is None else sum(1 << i for i, x in enumerate(v) if x is not None and x > 0) for v in vecs]
    for q in range(0, len(vecs), 20):
        if code[q] is None:
            assert not [x for x in got if x.query_id == q]
            continue
        want = sorted(((code[q] ^ c).bit_count(), i) for i, c in enumerate(code) if c is not None)[:10]
        assert sorted((x.distance, x.neighbor_id) for x in got if x.query_id == q) == want
    few = topk.top_k(rows.limit(3), rows.limit(1), 10)
    assert few.count() == 3
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


# op7


def test_chunks_rejoin_and_resist_shifts():
    r = random.Random(9)
    lines = [prose(r, 5) for _ in range(60)]
    a = line_dedup.chunks("\n".join(lines))
    assert "\n".join(a) == "\n".join(lines)
    b = line_dedup.chunks("\n".join(["new line", *lines]))
    assert len(set(a) & set(b)) >= len(a) - 2


def test_line_dedup_matches_plain(spark, edge, nothing):
    r = random.Random(10)
    block = [prose(r, 6) for _ in range(12)]
    rows = [(i, "\n".join([prose(r, 5) for _ in range(r.randint(0, 6))] + (block if i % 2 else block[3:9]) + [prose(r, 4)]), None, None) for i in range(20)]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    first = {}
    for d, t, *_ in rows:
        for i, c in enumerate(line_dedup.chunks(t)):
            if line_dedup.counts(c):
                first.setdefault(c, (d, i))
    for d, t, *_ in rows:
        parts = line_dedup.chunks(t)
        kept = [c for i, c in enumerate(parts) if not line_dedup.counts(c) or first[c] == (d, i)]
        assert got[d].text == "\n".join(kept) and got[d].removed_lines == sum(c.count("\n") + 1 for c in parts) - sum(c.count("\n") + 1 for c in kept)
    assert sum(x.removed_lines for x in got.values()) > 50
    out = line_dedup.dedup_lines(edge).collect()
    assert len(out) == 9 and sum(x.removed_lines for x in out) == 0
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_no_line_of_a_copy_stays(spark):
    r = random.Random(17)
    texts = ["\n".join(prose(r, 5) if r.random() < 0.8 else "" for _ in range(r.randint(4, 15))) for _ in range(60)]
    for t in texts:
        parts = line_dedup.chunks(t)
        assert "\n".join(parts) == t and (len(parts) == 1 or all(map(line_dedup.counts, parts)))
    got = {x.doc_id: x for x in line_dedup.dedup_lines(frame(spark, [(100 * k + i, t, None, None) for i, t in enumerate(texts) for k in range(3)])).collect()}
    for d, x in got.items():
        if line_dedup.counts(texts[d % 100]):
            assert x.text == (texts[d] if d < 100 else ""), d


# op8

SHELL = '<html><head><title>T</title><style>x{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><header>Site</header><div class="cookie-notice">We use cookies</div>%s<aside>More</aside><div id="comments"><p>Nice post, dear author, thanks for all of it</p></div><form>Mail</form><footer>Foot</footer></body></html>'


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>Head &amp; more</h1><p>One\n  two<br>three<p>Four <b>five</b> &copy; six</article>", "Head & more\n\nOne two three\n\nFour five © six"),
        ('<div class="post-12"><p>Text of some length that stands here</p><script>var p="<p>no</p>"</script><!-- <p>no</p> --><p>and goes on</p><div class="ad">Buy</div></div>', "Text of some length that stands here\n\nand goes on"),
        ("<main><section><p>A first part</p></section><section><p>A second part</p></section></main>", "A first part\n\nA second part"),
        ("<article><p>Never closed, but said <i>in full", "Never closed, but said in full"),
    ],
)
def test_extraction(body, want):
    page = html_extract.Page(SHELL % body if "Never" not in body else body)
    votes = page.votes()
    assert page.text([votes[0][0]]) == want


def test_broken_and_deep_pages_take_linear_time():
    deep = html_extract.Page("<div>" * 5000 + "<p>deep text" + "</div>" * 5000)
    assert deep.text([]) == "deep text"
    for html in ("<article><p>Hi there</p>" + "<p x=\"" * 30_000, "<article><p>Hi there</p>" + "<a " * 60_000, "<article><p>Hi there</p>" + "</b></td>" * 60_000, "<article><p>Hi there</p>" + "<!-- " * 60_000):
        assert html_extract.Page(html).text([]) == "Hi there"
    assert html_extract.Page('<article><p title="5" tall">First</p><p>Sec < ond</p></article>').text([]) == "First\n\nSec < ond"


def test_names_that_hint_and_forms_are_judged_by_what_they_hold():
    long = "Prior work is described in some detail here. " * 12
    page = html_extract.Page(f'<body><form><article><h1>T</h1><p>{long}</p><section class="related work"><p>{long}</p></section><section class="notice-of-death"><p>He died</p></section><div class="notice">Mind the gap</div><fieldset><p>A box of text</p></fieldset><fieldset><input name=q>Your name</fieldset><label for=q>Name</label></article></form></body>')
    assert page.text([]) == f"T\n\n{long.strip()}\n\n{long.strip()}\n\nHe died\n\nA box of text"
    half = html_extract.Page(f'<body><div class="story"><h1>T</h1><p>{long}</p><blockquote><p>{long}</p><p>{long}</p></blockquote></div><div class="side"><p>{long}</p></div></body>')
    assert half.text([]).startswith("T\n\n") and half.text([]).count("Prior") == 36


def plain_extraction(pages):
    """Votes and extraction again, from their definitions: (id, host, html) -> text."""
    from collections import defaultdict

    share, mass, firsts = defaultdict(float), defaultdict(float), defaultdict(int)
    for _, h, html in pages:
        by = defaultdict(float)
        page = html_extract.Page(html)
        for c in range(len(page.tag)):
            if page.tag[c] in html_extract.WITHIN:
                continue
            total = 0.0
            for at, text, link in page.blocks:
                steps, x = 0, at
                while x > c:
                    steps += page.tag[x] not in html_extract.WITHIN
                    x = page.parent[x]
                if x == c and not page.gone[at]:
                    total += max(0.0, len(text) - 2.0 * link) / 2**steps
            if total:
                by[page.path[c]] += total * (2 if page.tag[c] in ("article", "main") else 1)
        votes = sorted(by.items(), key=lambda x: (-x[1], x[0]))[:3]
        for p, s in votes:
            share[h, p] += s / votes[0][1]
            mass[h, p] += np.log1p(s)
            firsts[h] += s == votes[0][1]
    out = {}
    for i, h, html in pages:
        page = html_extract.Page(html)
        won = sorted((-round(s, 3), -round(mass[g, p], 3), html_extract.signed(p), p) for (g, p), s in share.items() if g == h and round(s, 3) >= 0.1 * firsts[h])
        out[i] = page.text([p for *_, p in won])
    return out


def test_extraction_matches_plain(spark):
    """Two templates a host, and pages that have neither."""
    r = random.Random(19)
    rows = []
    for i in range(60):
        box = f'<div class="box"><p>{prose(r, r.randint(5, 30))}</p><ul><li>{prose(r, 9)}</li><li><a href="/">{prose(r, 5)}</a></li></ul></div>'
        body = (f'<div class="story-{i}"><h2>{prose(r, 3)}</h2><p>{prose(r, r.randint(3, 60))}</p></div>', f'<section id="post{i}"><p>{prose(r, r.randint(3, 60))}</p></section>', f"<table><tr><td>{prose(r, 20)}</td><td>{prose(r, 8)}</td></tr></table>")[min(2, i % 7 // 3)]
        rows.append((i, f"https://{'ab'[i % 2]}.example/{i}", SHELL % (body + box)))
    got = {x.page_id: x.text for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == plain_extraction([(i, u.split("/")[2], h) for i, u, h in rows])
    assert all("box" not in h.split("</div>")[0] or t for (_, _, h), t in zip(rows, got.values(), strict=True))


def test_hosts_agree(spark):
    r = random.Random(11)
    html = lambda i, n: SHELL % f'<div class="story-{i}"><p>{prose(r, n)}</p></div><div class="box"><p>{prose(r, 12)}</p></div>'
    rows = [(i, f"https://h.example/{i}", html(i, 60)) for i in range(6)] + [(6, "https://h.example/6", html(6, 4)), (7, None, None), (8, "x", ""), (9, "https://other.example", "just text"), (9, "https://other.example", "just text")]
    got = {x.page_id: x for x in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got[6].text.split()) == 4  # its host's container, though another of its own holds more
    assert (got[7].text, got[7].n_chars, got[8].text) == ("", 0, "") and got[9].text == "just text"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_are_articles(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").limit(40)
    for p in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        import html as h

        plain = " ".join(h.unescape(re.sub(r"<[^>]+>", " ", article)).split())
        assert " ".join(p.text.split()) == plain


# op9


def plain_windows(v, width):
    """Every subsequence of at least width, by its leftmost minimum's value."""
    return {(i, j): min(v[i : j + 1]) for i in range(len(v)) for j in range(i + width - 1, len(v))}


def test_windows_partition_all_subsequences():
    r = random.Random(12)
    for ties in (False, True):
        for _ in range(15):
            parts = [[r.randrange(6 if ties else 10**9) << 32 for _ in range(r.randint(0, 30))] for _ in range(3)]
            ends = np.cumsum([len(p) for p in parts])
            v = np.array([x for p in parts for x in p], np.uint64)
            w = list(zip(*(x.tolist() for x in substring_dedup.windows(v, np.r_[0, ends[:-1]], ends, 4)), strict=True))
            for start, part in zip(np.r_[0, ends[:-1]].tolist(), parts, strict=True):
                for (i, j), low in plain_windows(part, 4).items():
                    own = [c for a, c, z in w if a <= i + start <= c <= j + start <= z]
                    assert len(own) == 1 and v[own[0]] == low


def test_one_repeated_word_is_shallow():
    v = np.zeros(200_000, np.uint64)
    assert len(substring_dedup.windows(v, np.array([0]), np.array([len(v)]), 46)[0]) < 200_000


def test_shared_passages_are_found(spark, edge, nothing):
    r = random.Random(13)
    passage, near = prose(r, 70), prose(r, 90).split()
    changed = list(near)
    changed[40] = "other"
    rows = [(i, f"{prose(r, r.randint(20, 200))} {passage} {prose(r, r.randint(20, 200))}", None, None) for i in range(1, 40)]
    rows += [(100, f"{prose(r, 60)} {' '.join(near)}", None, None), (101, f"{' '.join(changed)} {prose(r, 80)}", None, None)]
    rows += [(i, prose(r, 300), None, None) for i in range(200, 230)] + [(300, prose(r, 55) + " end", None, None)] * 2 + [(400, passage[:200], None, None)]
    got = {x.doc_id: x for x in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {*range(1, 40), 100, 101, 300}
    for d, t, *_ in rows[:39]:
        words = t.split()
        at = next(i for i in range(len(words)) if words[i : i + 70] == passage.split())
        assert any(s.start <= at + 2 and s.end >= at + 68 for s in got[d].spans), d
    assert got[300].copies == 2 and got[300].class_id == 300
    pairs = [(d, o) for d, x in got.items() for o in x.partners]
    assert len({frozenset(p) for p in pairs}) == len(pairs) and {x for p in pairs for x in p} == {*range(1, 40), 100, 101} and {100, 101} in [set(p) for p in pairs]
    assert {x.doc_id for x in substring_dedup.repeated_passages(edge).collect()} == set()
    assert substring_dedup.repeated_passages(nothing).count() == 0


def test_passages_around_a_frequent_stretch_are_found(spark):
    """49 words that 120 documents share, and 2 more after them that only two share each: no run of the 49 words' minima is short."""
    r = random.Random(15)
    frequent = prose(r, 49)
    rows = [(i, f"{prose(r, 79)} l{i} {frequent} {f'p{i // 2} q{i // 2} ' if i < 40 else ''}r{i} {prose(r, 80)}", None, None) for i in range(120)]
    got = {x.doc_id: x for x in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == set(range(40))
    for d, x in got.items():
        assert any(s.start <= 80 and s.end >= 131 and s.other == d ^ 1 for s in x.spans), d


def test_near_copies_in_long_runs_are_found(spark):
    """Many texts share a stretch too short to be a passage; pairs of them are near copies around it, at neither end of the run."""
    r = random.Random(31)
    vocab = [f"v{i}" for i in range(4000)]
    hot = prose(r, 40, vocab)
    rows = []
    for i in range(60):
        before, after = prose(r, 20, vocab), prose(r, 40, vocab)
        for k in (0, 1):
            words = f"{before} {hot} {after}".split()
            words[(5, 90)[k]] = f"other{i}"  # each copy differs from its twin in one word, far from the hot stretch
            rows.append((2 * i + k, " ".join(words), "en", "a"))
    docs = frame(spark, rows)
    found = {run: {x.doc_id: x for x in substring_dedup.repeated_passages(docs, run).collect()} for run in (1, 4, 10_000)}
    # four hash functions of which two must agree miss a near pair at times; a long run must miss none beside
    assert len(found[10_000]) >= 0.95 * len(rows)
    for run in (1, 4):
        assert found[run].keys() == found[10_000].keys()
        twins = {i for i, x in found[run].items() if any(p == i ^ 1 for p in x.partners)}
        most = {i for i, x in found[10_000].items() if any(p == i ^ 1 for p in x.partners)}
        assert len(twins) >= 0.9 * len(most)


def test_runs_within_the_limit_give_all_pairs_however_batches_fall(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(substring_dedup, "GATHERED", 1000)
    n = 5300
    f = pd.DataFrame({"key": np.int64(8), "a": np.arange(n), "sides": np.int64(0), "reach": np.int64(30 << 32 | 30), "c": np.int32(40)})
    assert sum(len(x) for x in substring_dedup.pair_up((f[i : i + 500] for i in range(0, n, 500)), 10_000)) == n * (n - 1) // 2


def test_hot_stretches_pair_every_place_with_another_class(spark, monkeypatch):
    r = random.Random(23)
    rows = sorted({(h, r.randrange(3 + 9 * h), r.randrange(1000)) for h in range(4) for _ in range(90)} | {(9, 5, i) for i in range(50)})
    df = spark.createDataFrame(rows, "h long, a long, i int")
    monkeypatch.setattr(substring_dedup, "CHAINED", 20)
    hot = df.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / 20).cast("int").alias("salts")).where("salts > 1")
    pairs = {((x.a, x["at"] >> 32), (x.b, x["at"] & 0xFFFFFFFF)) for x in substring_dedup.stars(df, hot).collect()}
    of = {}
    for h, a, i in rows:
        of.setdefault((a, i), set()).add(h)
    assert all(x[0] < y[0] and of[x] & of[y] for x, y in pairs)
    assert {p for pair in pairs for p in pair} >= {(a, i) for h, a, i in rows if h != 9}


def test_chains_reach_every_place_in_any_batches():
    import pandas as pd

    r = random.Random(16)
    rows = sorted((r.randrange(12), r.randrange(6), r.randrange(1000)) for _ in range(150))
    f = pd.DataFrame(rows, columns=["h", "a", "i"])
    for step in (1, 4, 1000):
        out = pd.concat(list(substring_dedup.chain(f.iloc[k : k + step] for k in range(0, len(f), step))))
        pairs = {((a, at >> 32), (b, at & 0xFFFFFFFF)) for a, b, at in out.itertuples(index=False)}
        of = {}
        for h, a, i in rows:
            of.setdefault((a, i), set()).add(h)
        assert all(x[0] < y[0] and of[x] & of[y] for x, y in pairs)
        ends = {p for pair in pairs for p in pair}
        assert all((a, i) in ends for h, a, i in rows if any(g == h and c != a for g, c, _ in rows))


# op10


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({toxicity.fold(w).strip(): 5.0 for w in ("idiot", "trash", "clown", "retard")}, [-4.0, 3.0, 0.5])
    clean = lex.score("a fine day")
    for t in ("You IDIOT", "you 1d10t!", "you іdіоt", "ídïöt", "ｉｄｉｏｔ", "idiots all", "idio\u0301t", "id\u200biot", "\u0131d\u0131ot", "you trash cannot behave", "trash candidate", "a clown fisherman"):
        assert lex.score(t) > 0.7 > clean, t
    for t in ("put it in the trash can", "the trash-can, full", "two trash cans", "flame retardant fabric", "patriotidiot", "", None):
        assert lex.score(t) == clean, t
    assert lex.score("idiot " + "word " * 5000) < lex.score("idiot word")


def test_matching_is_what_a_plain_matcher_finds():
    entries = {"ab": 1.0, "abc": 2.0, "b": 0.5, "trash": 4.0, "c a": 3.0}
    lex = toxicity.Lexicon(entries, [0.0, 1.0, 1.0])
    phrases = {tuple(toxicity.fold(p + s).split()) for p in toxicity.EXCEPTIONS for s in ("", "s")}
    r = random.Random(20)
    for _ in range(500):
        words = [r.choice(["ab", "abc", "b", "c", "a", "trash", "can", "cans", "bin", "soap", "scum", "trashcan", "x"]) for _ in range(r.randint(0, 12))]
        folded = toxicity.fold(" ".join(words))
        words, at, total = folded.split(), [], 0.0
        for w in words:
            at.append((at[-1][1] + 1 if at else 0, (at[-1][1] + 1 if at else 0) + len(w)))
        safe = [(at[i][0], at[i + len(p) - 1][1]) for p in phrases for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p]
        for s, _ in at:
            fits = [x for w, x in entries.items() if folded[1:].startswith(w, s) and not any(a <= s and s + len(w) <= b + 1 for a, b in safe)]
            total += max(fits, default=0.0)
        assert lex.features(folded) == pytest.approx((np.log1p(total), np.log1p(100 * total / max(1, len(words))))), folded


@pytest.mark.parametrize("name", ["held_out", "score", "Predicted", "gone", "n_lines", "range", "target", "leaks", "kept", "row"])
def test_kept_columns_never_clash(spark, name):
    df = frame(spark, [(1, "a b c d e f\ng h", "en", "s"), (2, "a b c d e f\ng h", "en", "s")]).withColumn(name, F.lit("x"))
    model = {"entries": {"idiot": 4.0}, "curve": [-4.0, 1.0, 1.0]}
    bench = spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string")
    for out in (toxicity.score_toxicity(df, model, keep=(name, "lang")), line_dedup.dedup_lines(df, keep=("doc_id", "text", name)), mixing.mix_sources(df, keep=(name, "lang")), decontaminate.annotate(df, bench, keep=("doc_id", name))):
        assert len({c.lower() for c in out.columns}) == len(out.columns) and name.lower() in {c.lower() for c in out.columns} | set("held_out score predicted n_lines target leaks".split())
        assert out.count() == 2


def test_toxicity(spark, edge, nothing):
    r = random.Random(14)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = prose(r, 60).split()
        for _ in range(2 if bad else 0):
            words.insert(r.randrange(60), r.choice(["zorkix", "zorkan", "idiot"]))
        rows.append((i, " ".join(words), None, None))
        labels.append((i, int(bad)))
    docs, lab = frame(spark, rows), spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit(docs, lab)).join(lab, "doc_id").where("held_out").collect()
    assert len(got) > 100 and all((x.predicted == 1) == (x.toxic == 1) and 0 <= x.score <= 1 for x in got)
    model = toxicity.fit(edge, lab.limit(0))
    out = toxicity.score_toxicity(edge, model).collect()
    assert len(out) == 9 and all(x.predicted == 0 for x in out)
    assert toxicity.score_toxicity(nothing, model).count() == 0
