"""Worksheet queries, one per SQL family a worksheet user reaches through
``spark.sql`` (SURVEY §2.6). The same text is its own DuckDB oracle.

Two families are written so that their output grows linearly with the data:
the theta join is an equi join with a non-equi residual (no nested loop), and
the self join pairs each line item with the next line of the same order (1:1),
instead of all pairs inside a group. CROSS JOIN runs in a worksheet like any
SQL but is not registered here (it emits all pairs by definition).
"""

WORKSHEET_SQL = {
    "ws_project": "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders",
    "ws_filter_range": (
        "SELECT o_orderkey FROM orders "
        "WHERE o_totalprice BETWEEN 1000 AND 5000 AND o_orderstatus IN ('F','O')"),
    "ws_case": (
        "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' ELSE 'L' END "
        "AS bucket FROM part"),
    "ws_inner_join": (
        "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"),
    "ws_left_join": (
        "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o "
        "ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000"),
    "ws_full_join": (
        "SELECT c.c_custkey, s.s_suppkey FROM customer c FULL OUTER JOIN supplier s "
        "ON c.c_custkey = s.s_suppkey + 1450"),
    "ws_right_join": (
        "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c "
        "ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'"),
    "ws_semi_join": (
        "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o "
        "WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')"),
    "ws_anti_join": (
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o "
        "WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')"),
    "ws_theta_join": (
        "SELECT l.l_orderkey, l.l_linenumber, o.o_totalprice FROM lineitem l JOIN orders o "
        "ON l.l_orderkey = o.o_orderkey AND l.l_extendedprice * 4 > o.o_totalprice"),
    "ws_self_join": (
        "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey AS next_partkey "
        "FROM lineitem a JOIN lineitem b "
        "ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"),
    "ws_multi_join": (
        "SELECT r.r_name, COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
        "JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
        "JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name"),
    "ws_group_agg": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MIN(l_quantity) AS lo, "
        "MAX(l_quantity) AS hi, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total "
        "FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "ws_having": (
        "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15"),
    "ws_count_distinct": (
        "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus"),
    "ws_select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "ws_grouping_sets": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem "
        "GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "ws_cube": (
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders "
        "GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "ws_rollup": (
        "SELECT r_name, n_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey "
        "GROUP BY ROLLUP (r_name, n_name)"),
    "ws_rank": (
        "SELECT s_suppkey, "
        "CAST(RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS BIGINT) AS rk, "
        "CAST(DENSE_RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS BIGINT) AS drk, "
        "CAST(ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) "
        "AS rn FROM supplier"),
    "ws_lag_lead": (
        "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_id, "
        "LEAD(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events"),
    "ws_frame_rows": (
        "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
        "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, MAX(o_totalprice) OVER (PARTITION BY "
        "o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
        "AS run_max FROM orders"),
    "ws_topk": (
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "ws_union_all": (
        "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier"),
    "ws_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "ws_intersect": (
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier"),
    "ws_except": (
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders "
        "WHERE o_orderstatus = 'P'"),
    "ws_cte": (
        "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) "
        "SELECT o_orderstatus, COUNT(*) AS n FROM big GROUP BY o_orderstatus"),
    "ws_scalar_subquery": (
        "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)"),
    "ws_in_subquery": (
        "SELECT p_partkey FROM part WHERE p_partkey IN "
        "(SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"),
    "ws_string_fns": (
        "SELECT c_custkey, UPPER(c_mktsegment) AS u, SUBSTRING(c_name, 10, 9) AS num, "
        "CAST(LENGTH(c_name) AS BIGINT) AS len, CONCAT(c_mktsegment, '-', c_name) AS j, "
        "REPLACE(c_name, '#', ':') AS r FROM customer"),
    "ws_date_fns": (
        "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS BIGINT) AS y, "
        "CAST(MONTH(o_orderdate) AS BIGINT) AS m, CAST(o_orderdate AS DATE) AS d FROM orders"),
    "ws_math_fns": (
        "SELECT s_suppkey, ROUND(s_acctbal, 1) AS r1, ABS(s_acctbal) AS a, "
        "CAST(FLOOR(s_acctbal) AS BIGINT) AS f FROM supplier"),
    "ws_null_fns": (
        "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'P'), 'none') AS s FROM orders"),
}
