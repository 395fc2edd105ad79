"""DuckDB oracle SQL for the registered queries (tables are views named as the
given parquet files). Column names match the Spark side exactly."""

from __future__ import annotations

from vantage.plans.worksheet_sql import WORKSHEET_SQL

# Fixed test-data schemas (FIXTURES §2): (table, [(column, Spark type text)]).
TPCH_SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
}
ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _counts(connection: str, source: str, tables) -> str:
    return " UNION ALL ".join(
        f"SELECT '{connection}' AS connection, '{source}' AS source, '{t}' AS \"table\", "
        f"COUNT(*) AS n_rows FROM {t}" for t in tables)


def _structure() -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{ty}' AS data_type, true AS nullable, "
        f"COUNT(*) AS n_rows, COUNT({c}) AS non_null FROM orders"
        for i, (c, ty) in enumerate(TPCH_SCHEMAS["orders"], start=1))


def _diagnose() -> str:
    ok = " UNION ALL ".join(
        f"SELECT 'warehouse' AS connection, '{t}' AS \"table\", 'read' AS mode, true AS ok, "
        f"'ok' AS message, COUNT(*) AS n_rows FROM {t}" for t in TPCH_SCHEMAS)
    return (ok + " UNION ALL SELECT 'broken', 'no_such_table', 'read', false, 'missing', "
            "CAST(NULL AS BIGINT)")


def _search(table: str, needle: str) -> str:
    cols = [c for c, _ in TPCH_SCHEMAS[table]]
    cond = " OR ".join(f"contains(lower(CAST({c} AS VARCHAR)), '{needle.lower()}')" for c in cols)
    return f"SELECT * FROM {table} WHERE {cond}"


_NULLIF = "NULLIF(o_orderstatus, 'P')"
_FLAT = ("SELECT o_orderkey, o_custkey AS o_cust, o_totalprice AS o_deep_price, "
         "o_orderstatus AS o_deep_status FROM orders")
_SET = ("trim(o_orderstatus) = 'F' AND starts_with(trim(o_orderpriority), '1-') AND "
        "contains(CAST(o_orderdate AS VARCHAR), '-03-')")

ORACLE_SQL = {
    "scan_parquet": "SELECT * FROM lineitem",
    "scan_csv": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "scan_json": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "scan_json_payload": (
        "SELECT o_orderkey AS key_o_orderkey, o_custkey AS key_o_custkey, "
        "o_orderstatus AS info_o_orderstatus, o_totalprice AS info_o_totalprice, "
        "o_orderdate AS info_o_orderdate, o_orderpriority FROM orders"),
    "catalog_tables": _counts("warehouse", "parquet", ALL_TABLES),
    "structure": _structure(),
    "register_connection": _counts("uploads", "parquet", ("orders", "nation")),
    "diagnose": _diagnose(),
    "diagnose_files": " UNION ALL ".join(
        f"SELECT 'warehouse' AS connection, '{t}' AS \"table\", '{t}.parquet' AS file, true AS ok, 'ok' AS message, "
        f"COUNT(*) AS n_rows FROM {t}" for t in ALL_TABLES),
    "null_fill": f"SELECT o_orderkey, COALESCE({_NULLIF}, 'Null') AS o_orderstatus FROM orders",
    "flatten_one_level": _FLAT,
    "flatten_full": _FLAT,
    "project": "SELECT o_orderkey, o_totalprice FROM orders",
    "sort_preview": ("SELECT o_orderkey, o_totalprice FROM orders "
                     "ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"),
    "search_any_column": _search("customer", "BUILD"),
    "filter_equal_int": "SELECT * FROM part WHERE trim(CAST(p_size AS VARCHAR)) = '7'",
    "filter_equal_double": "SELECT * FROM lineitem WHERE trim(CAST(l_quantity AS VARCHAR)) = '23.0'",
    "filter_not_equal": "SELECT * FROM orders WHERE trim(o_orderstatus) <> 'F'",
    "filter_contains": "SELECT * FROM part WHERE contains(trim(p_name), 'ing')",
    "filter_not_contains": "SELECT * FROM part WHERE NOT contains(trim(p_name), 'ing')",
    "filter_starts_with": (
        "SELECT * FROM orders WHERE starts_with(CAST(o_orderdate AS VARCHAR), '1997-01')"),
    "filter_ends_with": "SELECT * FROM part WHERE ends_with(trim(p_name), 'ring')",
    "filter_null": (f"SELECT o_orderkey, {_NULLIF} AS o_orderstatus FROM orders "
                    f"WHERE {_NULLIF} IS NULL"),
    "filter_not_null": (f"SELECT o_orderkey, {_NULLIF} AS o_orderstatus FROM orders "
                        f"WHERE {_NULLIF} IS NOT NULL"),
    "filter_null_token": (f"SELECT o_orderkey, {_NULLIF} AS o_orderstatus FROM orders "
                          f"WHERE trim(COALESCE({_NULLIF}, 'Null')) = 'Null'"),
    "filter_set": f"SELECT * FROM orders WHERE {_SET}",
    "filter_removed": ("SELECT * FROM orders WHERE trim(o_orderstatus) = 'F' AND "
                       "contains(CAST(o_orderdate AS VARCHAR), '-03-')"),
    "filter_like_mode": "SELECT * FROM part WHERE trim(p_name) LIKE '%s%ing%'",
    "calculated_column": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, "
        "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) "
        "AS DOUBLE) AS net FROM lineitem"),
    "json_keypaths": (
        "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events "
        "WHERE json_exists(props, '$.k')"),
    "worksheet_cross_source": (
        "SELECT c.c_mktsegment, COUNT(*) AS n_orders, "
        "CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total "
        "FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"),
    "worksheet_same_name": (
        "SELECT a.n_nationkey, a.n_name, b.n_regionkey FROM nation a "
        "JOIN nation b ON a.n_nationkey = b.n_nationkey"),
    "materialise_roundtrip": "SELECT * FROM lineitem",
    "materialise_structure": _structure(),
    "export_csv": "SELECT * FROM orders",
    "export_documents_csv": "SELECT * FROM documents",
    "bucketed_hot_join": (
        "SELECT o.o_orderstatus, l.l_returnflag, COUNT(*) AS n_lines, CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty "
        "FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN (SELECT MIN(o_orderkey) FROM orders) ELSE l_orderkey END AS k, * FROM lineitem) l "
        "JOIN orders o ON o.o_orderkey = l.k GROUP BY ALL"),
    "search_skipping": (
        "SELECT doc_id, lang, source, n_chars FROM documents WHERE contains(lower(text), 'license') "
        "OR contains(lower(lang), 'license') OR contains(lower(source), 'license')"),
    "uploads_replaced": (
        "SELECT o_orderkey, o_orderstatus, o_totalprice + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_totalprice FROM orders"),
    "snapshot_refresh": (
        "SELECT 1 AS version, o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL "
        "SELECT 2, o_orderkey, o_orderstatus, o_totalprice + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END FROM orders"),
    "create_from_join": (
        "SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment FROM orders o "
        "JOIN customer c ON o.o_custkey = c.c_custkey"),
    "flagship": (
        "SELECT r.r_name, n.n_name, COUNT(*) AS n_lines, "
        "CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue "
        "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
        "JOIN customer c ON o.o_custkey = c.c_custkey "
        "JOIN nation n ON c.c_nationkey = n.n_nationkey "
        "JOIN region r ON n.n_regionkey = r.r_regionkey "
        "WHERE trim(o.o_orderstatus) = 'O' GROUP BY r.r_name, n.n_name"),
}
ORACLE_SQL.update({
    "json_keypaths_nested": (
        "SELECT o_orderkey, 'key.id' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM orders "
        "UNION ALL SELECT o_orderkey, 'parties.id' AS path, CAST(o_custkey AS VARCHAR) AS value "
        "FROM orders"),
    "json_keypaths_deep": (
        "SELECT o_orderkey, 'l1.l2.l3.l4.l6.l7.l8.l9.l10.l11.leaf' AS path, "
        "CAST(o_custkey AS VARCHAR) AS value FROM orders"),
    "json_keypaths_combined": (
        "SELECT o_orderkey, 'parties' AS path, "
        "'[{\"id\":' || CAST(o_custkey AS VARCHAR) || ',\"status\":\"' || o_orderstatus || '\"}]' "
        "AS value, CAST(o_custkey AS VARCHAR) || o_orderstatus AS combined FROM orders"),
    "view_preview": (
        "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_shipdate FROM lineitem "
        "WHERE trim(l_returnflag) = 'R' AND starts_with(CAST(l_shipdate AS VARCHAR), '1995') "
        "AND (contains(CAST(l_orderkey AS VARCHAR), '0.0') OR contains(CAST(l_linenumber AS VARCHAR), '0.0') "
        "OR contains(CAST(l_extendedprice AS VARCHAR), '0.0') OR contains(CAST(l_discount AS VARCHAR), '0.0') "
        "OR contains(CAST(l_shipdate AS VARCHAR), '0.0')) "
        "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100"),
    "search_documents": (
        "SELECT doc_id, lang, source, n_chars FROM documents WHERE "
        "contains(lower(text), 'license') OR contains(lower(lang), 'license') "
        "OR contains(lower(source), 'license')"),
    "filter_documents": (
        "SELECT doc_id, lang, source, n_chars FROM documents WHERE "
        "contains(trim(text, ' '), 'the') AND ends_with(trim(text, ' '), '.') "
        "AND NOT contains(trim(source, ' '), 'x')"),
    "search_numeric": (
        "SELECT * FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), '77') "
        "OR contains(c_name, '77') OR contains(CAST(c_nationkey AS VARCHAR), '77') "
        "OR contains(CAST(c_acctbal AS VARCHAR), '77') OR contains(c_mktsegment, '77')"),
    "sort_nulls_preview": (
        f"SELECT o_orderkey, {_NULLIF} AS o_orderstatus FROM orders "
        f"ORDER BY {_NULLIF} ASC NULLS FIRST, o_orderkey DESC LIMIT 100"),
    "catalog_restricted": (
        "SELECT 'one' AS connection, 'parquet' AS source, 'lineitem' AS \"table\", "
        "COUNT(*) AS n_rows FROM lineitem"),
    "fill_then_not_equal": (
        f"SELECT o_orderkey, COALESCE({_NULLIF}, 'Null') AS o_orderstatus FROM orders "
        f"WHERE trim(COALESCE({_NULLIF}, 'Null')) <> 'F'"),
    "export_parquet_json": "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem",
    "bucketed_join": (
        "SELECT o_orderstatus, l_returnflag, COUNT(*) AS n_lines, "
        "CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "GROUP BY o_orderstatus, l_returnflag"),
    "filter_equal_timestamp": (
        "SELECT * FROM orders WHERE trim(CAST(o_orderdate AS VARCHAR)) = '1996-01-02 00:00:00'"),
    "filter_starts_with_int": (
        "SELECT * FROM part WHERE starts_with(trim(CAST(p_size AS VARCHAR)), '1')"),
})
ORACLE_SQL.update(WORKSHEET_SQL)
