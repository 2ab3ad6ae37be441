"""What changed between the last two crawls."""

from __future__ import annotations

from ..plans.dialect import Dialect

RANKS = ("crit", "high", "med", "low")


def changes(q: Dialect) -> str:
    """url_key, kind, severity (worst), n_changes, fields: pages added, removed or changed, worst first."""
    differ = lambda c: f"(o.{c} IS DISTINCT FROM n.{c})"
    rules = [
        ("status", 0, "o.status_code = 200 AND n.status_code IS DISTINCT FROM 200"),
        ("status", 2, f"{differ('status_code')} AND NOT (o.status_code = 200)"),
        ("indexable", 0, "o.indexable AND NOT n.indexable"),
        ("noindex", 0, "NOT coalesce(o.noindex, false) AND n.noindex"),
        ("canonical", 1, differ("canonical_key")),
        ("title", 2, differ("title")),
        ("h1", 3, differ("h1")),
        ("meta_description", 3, differ("meta_description")),
        ("schema", 2, "coalesce(o.schema_types, '') <> '' AND coalesce(n.schema_types, '') = ''"),
        ("word_count", 3, "o.word_count > 0 AND abs(n.word_count - o.word_count) >= 0.4 * o.word_count"),
    ]
    case = lambda r: f"CASE WHEN {r[2]} THEN {r[1]} END"
    found = lambda r: f"CASE WHEN {r[2]} THEN '{r[0]}' END"
    present = "o.url_key IS NOT NULL AND n.url_key IS NOT NULL"
    worst = f"least({', '.join(f'coalesce({case(r)}, 9)' for r in rules)})"
    count = " + ".join(f"CASE WHEN {r[2]} THEN 1 ELSE 0 END" for r in rules)
    last = "(SELECT max(captured_at) FROM p_snapshots)"
    one = lambda at: f"(SELECT * FROM p_snapshots WHERE captured_at = {at})"
    return f"""SELECT url_key, kind, CASE rank WHEN 0 THEN 'crit' WHEN 1 THEN 'high' WHEN 2 THEN 'med' WHEN 3 THEN 'low' ELSE 'info' END AS severity, n_changes, fields FROM (
        SELECT coalesce(n.url_key, o.url_key) AS url_key, CASE WHEN o.url_key IS NULL THEN 'added' WHEN n.url_key IS NULL THEN 'removed' ELSE 'modified' END AS kind,
        CASE WHEN o.url_key IS NULL THEN 4 WHEN n.url_key IS NULL THEN 1 ELSE {worst} END AS rank, CASE WHEN {present} THEN {count} ELSE 0 END AS n_changes, CASE WHEN {present} THEN concat_ws(', ', {', '.join(map(found, rules))}) ELSE '' END AS fields
        FROM {one(f'(SELECT max(captured_at) FROM p_snapshots WHERE captured_at < {last})')} o FULL OUTER JOIN {one(last)} n ON n.url_key = o.url_key) d WHERE kind <> 'modified' OR n_changes > 0"""


def staleness(q: Dialect) -> str:
    return "SELECT max(captured_at) AS last_snapshot, count(DISTINCT crawl_id) AS snapshots, (SELECT count(*) FROM p_pages p LEFT JOIN p_snapshots s ON s.url_key = p.url_key AND s.crawl_id = p.crawl_id WHERE s.url_key IS NULL) AS unsnapshotted FROM p_snapshots"


def freshness(q: Dialect, as_of: str | None = None, grace: int = 2) -> str:
    """raw_max, effective_max, trimmed_days: the last day whose facts are complete.

    Days within ``grace`` of as_of never count; of the rest, up to three trailing days under half the
    median of the stable days before (21, ending three days earlier) are trimmed, if there are eight.
    """
    day = f"DATE '{as_of}'" if as_of else "(SELECT day FROM p_day) + INTERVAL 2 DAY"
    return f"""WITH days AS (SELECT date, CAST(sum(impressions) AS BIGINT) AS i FROM p_sa WHERE date IS NOT NULL GROUP BY date),
        kept AS (SELECT date, i, row_number() OVER (ORDER BY date DESC) AS back, count(*) OVER () AS n FROM days WHERE date <= {day} - INTERVAL {grace} DAY AND date > {day} - INTERVAL 400 DAY),
        stable AS (SELECT i, row_number() OVER (ORDER BY i, date) AS place, count(*) OVER () AS n FROM kept WHERE back BETWEEN 4 AND 24),
        mid AS (SELECT max(i) AS median FROM stable WHERE place = floor(n / 2) + 1),
        low AS (SELECT back, CASE WHEN i * 2 < (SELECT median FROM mid) THEN 1 ELSE 0 END AS low FROM kept WHERE back <= 3),
        t AS (SELECT coalesce(min(CASE WHEN low = 0 THEN back END) - 1, count(*)) AS trimmed FROM low)
        SELECT (SELECT max(date) FROM days) AS raw_max, kept.date AS effective_max, CAST(CASE WHEN kept.n >= 8 THEN t.trimmed ELSE 0 END AS BIGINT) AS trimmed_days FROM kept, t WHERE kept.back = CASE WHEN kept.n >= 8 THEN t.trimmed ELSE 0 END + 1"""
