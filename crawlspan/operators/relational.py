"""The relational operators by themselves, over the driver's star schema."""

from __future__ import annotations

from ..plans.dialect import Dialect

OPS: dict = {}


def op(name: str, sql):
    OPS[name] = sql if callable(sql) else (lambda q, sql=sql: sql)


# filters and predicates
op("filter_compare", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus NOT IN ('F', 'P')")
op("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 7 AND l_discount >= 0.05")
op("filter_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BLUE%'")
op("filter_glob", lambda q: f"SELECT p_partkey, p_name FROM part WHERE {q.rlike('p_name', '^[a-c].* .*[dt]$')}")
op("null_safe_equality", lambda q: f"SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal < 0 WHERE c_mktsegment {'IS NOT DISTINCT FROM' if q.duck else '<=>'} CAST(NULL AS STRING) AND o_orderkey % 10 = 0")
op("coalesce_nullif_case", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), 'none') AS flag, CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS tax, greatest(20, l_quantity * 0.5) AS floor20 FROM lineitem WHERE l_linenumber = 1")
op("window_predicate", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_shipdate AS DATE) <= (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) AND CAST(l_shipdate AS DATE) > (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) - INTERVAL 28 DAY")
op("brand_exclusion", lambda q: "SELECT p_partkey, p_name FROM part WHERE NOT " + q.contains("concat(' ', lower(p_name), ' ')", "' blue '"))
# joins
op("join_inner", "SELECT n_name, count(*) AS suppliers, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")
op("join_left", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
op("join_right", "SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")
op("join_full", "SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, s, c FROM (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY s_nationkey) a FULL OUTER JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey) b ON s_nationkey = c_nationkey")
op("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
op("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
op("join_anti_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity > 49)")
op("join_anti_two_columns", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE l_linenumber = 1 AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey AND m.l_linenumber = 2)")
op("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
op("join_three_way", "SELECT r_name, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
op("join_expression_key", "SELECT split_part(p_name, ' ', 2) AS kind, count(*) AS n FROM part JOIN nation ON n_nationkey = length(split_part(p_name, ' ', 2)) GROUP BY 1")
op("join_folded_key", "SELECT p_partkey, k FROM part JOIN (SELECT DISTINCT upper(p_brand) AS b, 1 AS k FROM part WHERE p_size < 10) x ON x.b = upper(p_brand)")
op("join_scalar_subquery", "SELECT s_suppkey, (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines FROM supplier")
op("join_lateral", lambda q: f"SELECT p_partkey, w.x AS word FROM part, {q.unnest(q.split('p_name', ' '), 'w')}")
op("join_range", "SELECT p_partkey, b.lo FROM part JOIN (SELECT 0 AS lo, 10 AS hi UNION ALL SELECT 10, 30 UNION ALL SELECT 30, 60) b ON p_size >= b.lo AND p_size < b.hi")
op("join_as_of", "SELECT e.event_id, max(o.ts) AS last_view FROM events e JOIN events o ON o.user_id = e.user_id AND o.event_type = 'view' AND o.ts <= e.ts AND o.ts > e.ts - INTERVAL 1 DAY WHERE e.event_type = 'purchase' GROUP BY e.event_id")
op("join_best_match", "SELECT user_id, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id")
# aggregates
op("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, min(l_tax) AS least, max(l_tax) AS most, avg(l_quantity) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus")
op("agg_weighted_mean", "SELECT l_suppkey, sum(l_linenumber * l_quantity) / nullif(sum(l_quantity), 0) AS wavg FROM lineitem GROUP BY l_suppkey")
op("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15")
op("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
op("agg_conditional", "SELECT o_orderstatus, CAST(count_if(o_totalprice > 100000) AS BIGINT) AS large, CAST(sum(CASE WHEN o_totalprice <= 100000 THEN 1 ELSE 0 END) AS BIGINT) AS small FROM orders GROUP BY o_orderstatus")
op("agg_list", lambda q: f"SELECT n_regionkey, {q.join(q.listed('n_name'), ', ')} AS names FROM nation GROUP BY n_regionkey")
op("agg_of_agg", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n")
op("agg_labelled", "SELECT CASE WHEN p_size >= 40 THEN 'large' ELSE 'small' END AS label, min(p_size) AS lo, count(*) AS n FROM part GROUP BY 1")
op("agg_index_median", "SELECT l_suppkey, l_quantity AS median FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS place, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) t WHERE place = CAST(floor(n / 2) AS BIGINT) + 1")
op("agg_variation", "SELECT p_brand, round(stddev_pop(p_size) / avg(p_size), 9) AS cv FROM part GROUP BY p_brand")
op("agg_share", "SELECT o_orderpriority, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY o_orderpriority")
op("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
op("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
op("agg_rollup", "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
op("distinct", "SELECT DISTINCT p_brand, p_type FROM part")
# windows
op("window_row_number", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) t WHERE n = 1")
op("window_max", "SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS lead FROM lineitem) t WHERE l_quantity >= lead")
op("window_lag_lead", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
op("window_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
op("window_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events")
op("window_first_last", "SELECT user_id, min_by(event_type, event_id) AS first_type, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id")
op("window_examples", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) t WHERE n <= 3")
# sorts, limits, set operators
op("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
op("sort_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
op("sort_null_order", "SELECT c_custkey, n FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS n FROM customer) t ORDER BY n ASC NULLS FIRST, c_custkey LIMIT 100")
op("cap_with_count", "SELECT p_brand, p_partkey, n FROM (SELECT p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part) t WHERE place <= 5")
op("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
op("set_union_all", "SELECT 'c' AS src, c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey")
op("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
op("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
# scalar functions
op("fn_strings", lambda q: f"SELECT p_partkey, upper(trim(p_name)) AS u, replace(p_name, ' ', '-') AS slug, substring(p_name, 1, 3) AS s, length(p_name) AS n, {q.sub('p_name', '[aeiou]', '')} AS bare, concat(p_brand, '/', p_type) AS path FROM part")
op("fn_dates", lambda q: "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofyear(o_orderdate) AS doy, " + ("date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')" if q.duck else "datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE))") + " AS age FROM orders")
op("fn_week", lambda q: "SELECT o_orderkey, " + ("CAST(strftime(o_orderdate, '%W') AS INT)" if q.duck else "CAST(floor((dayofyear(o_orderdate) + 6 - weekday(o_orderdate)) / 7) AS INT)") + " AS week FROM orders")
op("fn_math", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 2) AS r, CAST(floor(l_quantity / 7 + 0.5) AS BIGINT) AS half_up, round(ln(l_quantity), 9) AS ln, round(sqrt(l_quantity), 9) AS root, round(1 / (1 + exp(-l_discount)), 9) AS sigmoid FROM lineitem WHERE l_linenumber = 1")
op("fn_ctr_curve", lambda q: f"SELECT DISTINCT l_linenumber, {q.ctr('l_linenumber * 1.5')} AS expected FROM lineitem")
op("fn_json", lambda q: "SELECT event_id, " + ("json_extract_string(props, '$.k')" if q.duck else "get_json_object(props, '$.k')") + " AS k FROM events")
op("fn_terms", lambda q: f"SELECT p_partkey, {q.join(q.terms('p_name'), '|')} AS terms FROM part")
A, B = (lambda q: q.split("lower(a.n_name)", " ")), (lambda q: q.split("lower(b.n_name)", " "))
op("fn_jaccard", lambda q: f"SELECT a.n_nationkey AS a, b.n_nationkey AS b, {q.size(q.common(A(q), B(q)))} / CAST({q.size(A(q))} + {q.size(B(q))} - {q.size(q.common(A(q), B(q)))} AS DOUBLE) AS jaccard FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
op("fn_arrays", lambda q: f"SELECT p_partkey, {q.size(q.split('p_name', ' '))} AS n, {q.has(q.split('p_name', ' '), chr(39) + 'blue' + chr(39))} AS blue FROM part")
op("fn_truncate", "SELECT doc_id, CASE WHEN length(text) > 120 THEN concat(substring(text, 1, 120), '...') ELSE text END AS shown FROM documents")
op("fn_mentions", lambda q: f"SELECT p_partkey FROM part WHERE {q.mentions('p_name', repr('widgets'))}")
# the classic report of a pricing summary, and a three-way revenue query
op("pricing_summary", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
op("rank_bands", "SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS period, count(CASE WHEN o_orderkey % 20 < 3 THEN 1 END) AS pos_1_3, count(CASE WHEN o_orderkey % 20 BETWEEN 3 AND 9 THEN 1 END) AS pos_4_10, count(*) AS keywords FROM orders GROUP BY 1")
