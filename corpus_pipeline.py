"""A training-corpus pipeline: five stages, each applying one operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspan.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity operator predicts toxic go. It learns from the labels of rows that aren't held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark, docs, sf_dir):
    """Repeated chunks of lines leave the text (their first occurrence stays); a document of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs, keep=COLUMNS)
    left = (F.col("removed_lines") == 0) | F.col("text").rlike(r"\S")
    return out.where(left).select("doc_id", "text", "lang", "source", F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group that similarity links join stays: the one with the smallest id."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that contain a benchmark item go."""
    found = decontaminate.annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """All documents that are left, with the words that the mix takes of each."""
    return mixing.mix_sources(docs, keep=("text", "lang", "n_chars")).select("doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix),
]


def run(spark, sf_dir):
    """STAGES applied to documents. Several stages scan their input more than once, so each result is cut from its lineage."""
    from crawlspan.llm.common import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i + 1 < len(STAGES) else docs
    return docs


#: The learned stage can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
