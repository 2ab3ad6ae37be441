"""Every query that SQL can express, on both engines; the others run and keep their schema."""

import pytest
from helpers import rows

from crawlspan.plans.registry import ORACLE, QUERIES

SLOW = ("audit_",)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    want = duck.execute(ORACLE[name])
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())


SEEDED = "chk_rag_answer_gap chk_answer_not_front_loaded chk_anchor_text_incoherent chk_breadcrumb_schema_inconsistent chk_ai_slop_signals alg_opportunities chk_indexed_junk_url".split()


@pytest.mark.parametrize("name", SEEDED)
def test_shows_something(spark, name):
    """At a size at which the property has pages for every rule."""
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE and not n.startswith(SLOW)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())
