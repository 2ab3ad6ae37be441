"""The pipeline's stages, each held against a plain version on its own input; the registered queries; oracles."""

import pytest
from helpers import plain

import corpus_pipeline
from crawlspan.llm import decontaminate, queries


def same(got, want):
    return sorted(str(tuple(plain(x) for x in r)) for r in got) == sorted(str(tuple(plain(x) for x in r)) for r in want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, data, duck, name):
    got = queries.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    assert same(got.select(*cols).collect(), want)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts, before = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, data)
        after = spark.createDataFrame(out.collect(), out.schema)
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == list(corpus_pipeline.COLUMNS)
        if name == "benchmark decontamination":
            items = [decontaminate.tokens(r.text or "") for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            clean, number = set(), {}
            ids_of = lambda words: [number.setdefault(w, len(number)) for w in words]
            for r in before.collect():
                doc = decontaminate.tokens(r.text or "")
                grams = {tuple(doc[i : i + 5]) for i in range(len(doc) - 4)}
                near = [x for x in items if len(x) < 5 or any(tuple(x[i : i + 5]) in grams for i in range(len(x) - 4))]
                if not any(x and sum(n for *_, n in decontaminate.tile(ids_of(doc), ids_of(x), min(5, len(x)))) >= decontaminate.COVERAGE * len(x) for x in near):
                    clean.add(r.doc_id)
            assert ids == clean
        if name == "n-gram Jaccard join":
            from test_operators import plain_components

            roots = plain_components({r.doc_id: r.text for r in before.collect()})
            assert ids == {d for d, (n, c) in roots.items() if c == d or not n}
        counts.append(after.count())
        before = after
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    assert sum(r.taken for r in before.collect()) > 0


def test_run_is_the_stages(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_one_of_planted_copies_stays(spark, data, tmp_path):
    """Of exact copies of several lines, the first document stays whole and no scraps of the others do."""
    import os
    import random

    r = random.Random(18)
    texts = ["\n".join(" ".join(f"w{r.randrange(400)}" for _ in range(8)) for _ in range(r.randint(3, 9))) for _ in range(15)]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    planted = [(10**9 + 100 * k + i, t, "en", "web", len(t)) for i, t in enumerate(texts) for k in range(3)]
    docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(planted, docs.select(*corpus_pipeline.COLUMNS).schema)).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        os.symlink(f"{data}/{name}.parquet", tmp_path / f"{name}.parquet")
    left = {x.doc_id: x.text for x in corpus_pipeline.run(spark, str(tmp_path)).where(f"doc_id >= {10**9}").collect()}
    assert left == {10**9 + i: t for i, t in enumerate(texts)}


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
