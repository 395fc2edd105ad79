"""The registered queries: one per operator of the inventory plus the worksheet
families, each ``(spark, sf_dir) -> DataFrame``, and their DuckDB oracle SQL.

Every query reads the given tables (or files Spark writes from them into the
shared folder) in full; none runs on made-up input.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.catalog import Catalog, with_row_counts
from vantage.functions.json_paths import IGNORED_KEYS, json_keypaths
from vantage.operators import shaping, sinks
from vantage.operators.predicates import FilterSpec, apply_filters, remove_filter
from vantage.plans.worksheet import Worksheet
from vantage.plans.worksheet_sql import WORKSHEET_SQL
from vantage.session import session_key, shared_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

CUSTOMER_DDL = ("c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING")
ORDERS_DDL = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")
DOCUMENTS_DDL = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
NATION_DDL = "n_nationkey INT, n_name STRING, n_regionkey INT"


_BASE: dict[tuple, Catalog] = {}


def warehouse(spark: SparkSession, sf_dir: str, tables=TABLES) -> Catalog:
    """A parquet connection ``warehouse`` over the given tables: a fork of one
    long-lived catalog per session and folder, so each table is listed and its
    schema resolved once, as a catalog in a running viewer would."""
    key = (session_key(spark), sf_dir, tuple(tables), *(_files(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    if key not in _BASE:  # listed again when the files change
        cat = Catalog(spark)
        cat.register("warehouse", "parquet", files=[f"{sf_dir}/{t}.parquet" for t in tables])
        _BASE[key] = cat
    return _BASE[key].fork()


def _staged(spark: SparkSession, df: DataFrame, fmt: str, name: str, **kw) -> str:
    path = shared_path(spark, "staged") + "/" + name  # table name = last segment
    sinks.export(df, path, fmt=fmt, **kw)
    return path


_CRM: dict[tuple, tuple[str, str]] = {}


def with_crm(spark: SparkSession, sf_dir: str, typed: bool = True) -> Catalog:
    """warehouse (parquet) + crm (CSV copies of customer and nation written by
    Spark into the shared folder once per session and folder, like a CSV
    connection that exists beside the warehouse). ``typed`` gives the CSV
    tables their schemas; otherwise they read as strings, as the viewer does."""
    cat = warehouse(spark, sf_dir)
    key = (session_key(spark), sf_dir, *(_files(spark, f"{sf_dir}/{t}.parquet") for t in ("customer", "nation")))
    if key not in _CRM:  # copied again when the files change
        _CRM[key] = (_staged(spark, cat.scan("warehouse", "customer"), "csv", "customer"),
                     _staged(spark, cat.scan("warehouse", "nation"), "csv", "nation"))
    cust, nat = _CRM[key]
    schemas = {"customer": CUSTOMER_DDL, "nation": NATION_DDL} if typed else {}
    cat.register("crm", "csv", files=[cust, nat], schemas=schemas)
    return cat


def _ws(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    cat = warehouse(spark, sf_dir)
    return Worksheet(cat).run(WORKSHEET_SQL[name])


def _orders_with_nulls(spark, sf_dir):
    o = warehouse(spark, sf_dir).scan("warehouse", "orders")
    return o.select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"))


# -- sources ------------------------------------------------------------------------

def scan_parquet(spark, sf_dir):
    return warehouse(spark, sf_dir).scan("warehouse", "lineitem")


def scan_csv(spark, sf_dir):
    """Customer written as CSV by Spark, scanned as strings, cast back."""
    cat = with_crm(spark, sf_dir, typed=False)
    raw = cat.scan("crm", "customer")  # all strings, as the viewer reads CSV
    return raw.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
                      F.col("c_nationkey").cast("int").alias("c_nationkey"),
                      F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


def scan_json(spark, sf_dir):
    """Nation written as JSON lines, scanned with a schema."""
    cat = warehouse(spark, sf_dir)
    path = _staged(spark, cat.scan("warehouse", "nation"), "json", "nation")
    cat.register("files", "json", files=[path], schemas={"nation": NATION_DDL})
    return cat.scan("files", "nation")


def scan_json_payload(spark, sf_dir):
    """S6 + T2: nested order payloads landed as many small files of one JSON
    document each (an array of about 500 orders), read in parallel and flattened
    one level."""
    cat = warehouse(spark, sf_dir)
    o = cat.scan("warehouse", "orders")
    payload = F.struct(F.struct("o_orderkey", "o_custkey").alias("key"),
                       F.struct("o_orderstatus", "o_totalprice", "o_orderdate").alias("info"),
                       "o_orderpriority")
    n = max(1, o.count() // 500)
    path = shared_path(spark, "staged") + "/orders"
    (o.groupBy(F.pmod(F.xxhash64("o_orderkey"), F.lit(n)).alias("doc"))
     .agg(F.to_json(F.collect_list(payload)).alias("value"))  # one document
     .select("value").write.option("maxRecordsPerFile", 1).text(path))
    schema = ("key STRUCT<o_orderkey: BIGINT, o_custkey: BIGINT>, info STRUCT<o_orderstatus: "
              "STRING, o_totalprice: DOUBLE, o_orderdate: TIMESTAMP_NTZ>, o_orderpriority STRING")
    cat.register("api", "api", files=[path], schemas={"orders": schema})
    return cat.scan("api", "orders")


# -- catalog --------------------------------------------------------------------------

def catalog_tables(spark, sf_dir):
    cat = warehouse(spark, sf_dir)
    return with_row_counts(spark, cat).select("connection", "source", "table", "n_rows")


def structure(spark, sf_dir):
    o = warehouse(spark, sf_dir).scan("warehouse", "orders")
    return shaping.structure(o, profile=True)


def register_connection(spark, sf_dir):
    """An upload registers a connection; a second upload of the same name
    replaces it. Listed with row counts."""
    cat = warehouse(spark, sf_dir)
    cat.register("uploads", "parquet", files=[f"{sf_dir}/customer.parquet"])
    cat.register("uploads", "parquet", files=[f"{sf_dir}/orders.parquet",
                                              f"{sf_dir}/nation.parquet"])
    only = Catalog(spark, [cat.connection("uploads")])
    return with_row_counts(spark, only).select("connection", "source", "table", "n_rows")


def diagnose_files(spark, sf_dir):
    """C9 by file: every column of every file of every given table is read; a row a
    file says whether it is whole, and how many rows it gave."""
    from vantage.operators.health import diagnose_files as _diagnose_files
    found = _diagnose_files(warehouse(spark, sf_dir))
    return found.select("connection", "table", F.element_at(F.split("file", "/"), -1).alias("file"), "ok", "message", "n_rows")


def diagnose(spark, sf_dir):
    from vantage.operators.health import diagnose as _diagnose
    cat = warehouse(spark, sf_dir, TPCH)
    cat.register("broken", "parquet", files=[f"{sf_dir}/no_such_table.parquet"])
    return _diagnose(cat, mode="read")


# -- shaping --------------------------------------------------------------------------

def null_fill(spark, sf_dir):
    return shaping.fill_null_token(_orders_with_nulls(spark, sf_dir))


def flatten_one_level(spark, sf_dir):
    o = warehouse(spark, sf_dir).scan("warehouse", "orders")
    nested = o.select("o_orderkey",
                      F.struct(F.col("o_custkey").alias("cust"),
                               F.struct(F.col("o_totalprice").alias("price"),
                                        F.col("o_orderstatus").alias("status")).alias("deep"))
                      .alias("o"))
    # one level: o_cust and o_deep (still a struct) -> select the struct's fields after
    flat = shaping.flatten(nested)
    return flat.select("o_orderkey", "o_cust", F.col("o_deep.price").alias("o_deep_price"),
                       F.col("o_deep.status").alias("o_deep_status"))


def flatten_full(spark, sf_dir):
    o = warehouse(spark, sf_dir).scan("warehouse", "orders")
    nested = o.select("o_orderkey",
                      F.struct(F.col("o_custkey").alias("cust"),
                               F.struct(F.col("o_totalprice").alias("price"),
                                        F.col("o_orderstatus").alias("status")).alias("deep"))
                      .alias("o"))
    return shaping.flatten(nested, depth=None)


def project(spark, sf_dir):
    o = warehouse(spark, sf_dir).scan("warehouse", "orders")
    return shaping.project(o, ["o_orderkey", "o_totalprice"])


def sort_preview(spark, sf_dir):
    o = warehouse(spark, sf_dir).scan("warehouse", "orders")
    return shaping.preview(shaping.project(o, ["o_orderkey", "o_totalprice"]), 100,
                           order=[("o_totalprice", "desc"), ("o_orderkey", "asc")])


def search_any_column(spark, sf_dir):
    c = warehouse(spark, sf_dir).scan("warehouse", "customer")
    return shaping.search(c, "BUILD")


def calculated_column(spark, sf_dir):
    li = warehouse(spark, sf_dir).scan("warehouse", "lineitem")
    return shaping.add_columns(
        li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"),
        {"net": "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * "
                "(1 - CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE)"})


def json_keypaths_query(spark, sf_dir):
    e = warehouse(spark, sf_dir).scan("warehouse", "events")
    return json_keypaths(e.select("event_id", "props"), "props", "k").select(
        "event_id", "path", "value")


# -- predicates -------------------------------------------------------------------------

def _filtered(table: str, *specs: FilterSpec):
    def run(spark, sf_dir):
        return apply_filters(warehouse(spark, sf_dir).scan("warehouse", table), specs)
    return run


def filter_null(spark, sf_dir):
    return apply_filters(_orders_with_nulls(spark, sf_dir), [FilterSpec("null", "o_orderstatus")])


def filter_not_null(spark, sf_dir):
    return apply_filters(_orders_with_nulls(spark, sf_dir),
                         [FilterSpec("not null", "o_orderstatus")])


def filter_null_token(spark, sf_dir):
    return apply_filters(_orders_with_nulls(spark, sf_dir),
                         [FilterSpec("null", "o_orderstatus", nulls="token")])


_SET = [FilterSpec("equal", "o_orderstatus", "F", id="1"),
        FilterSpec("starts with", "o_orderpriority", "1-", id="2"),
        FilterSpec("contains", "o_orderdate", "-03-", id="3")]


def filter_set(spark, sf_dir):
    return apply_filters(warehouse(spark, sf_dir).scan("warehouse", "orders"), _SET)


def filter_removed(spark, sf_dir):
    return apply_filters(warehouse(spark, sf_dir).scan("warehouse", "orders"),
                         remove_filter(_SET, "2"))


# -- worksheet ------------------------------------------------------------------------------

def worksheet_cross_source(spark, sf_dir):
    """CSV customer (crm) joined with parquet orders (warehouse)."""
    cat = with_crm(spark, sf_dir)
    q = ("SELECT c.c_mktsegment, COUNT(*) AS n_orders, "
         "CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total "
         "FROM crm__customer c JOIN warehouse__orders o ON o.o_custkey = c.c_custkey "
         "GROUP BY c.c_mktsegment")
    return Worksheet(cat).run(q, [("crm", "customer"), ("warehouse", "orders")])


def worksheet_same_name(spark, sf_dir):
    """Both connections have a table ``nation``; each gets its own view."""
    cat = with_crm(spark, sf_dir)
    q = ("SELECT a.n_nationkey, a.n_name, b.n_regionkey FROM warehouse__nation a "
         "JOIN crm__nation b ON a.n_nationkey = b.n_nationkey")
    return Worksheet(cat).run(q, [("warehouse", "nation"), ("crm", "nation")])


def materialise_roundtrip(spark, sf_dir):
    """K1 + K2 + S8: materialise lineitem; the next scan reads the copy."""
    cat = warehouse(spark, sf_dir)
    li = cat.scan("warehouse", "lineitem")
    sinks.materialise(li, catalog=cat, connection="warehouse", table="lineitem",
                      structure_path=shared_path(spark, "structure", "lineitem"))
    return cat.scan("warehouse", "lineitem")


def export_csv(spark, sf_dir):
    """K3/K4/K6: export orders as CSV (bounded file size), read back typed."""
    cat = warehouse(spark, sf_dir)
    path = _staged(spark, cat.scan("warehouse", "orders"), "csv", "orders",
                   max_records_per_file=5000)
    cat.register("export", "csv", files=[path], schemas={"orders": ORDERS_DDL})
    return cat.scan("export", "orders")


def export_documents_csv(spark, sf_dir):
    """K3/K6: whole document texts (line ends, quotes, blanks) exported as CSV and
    read back unchanged."""
    cat = warehouse(spark, sf_dir)
    path = _staged(spark, cat.scan("warehouse", "documents"), "csv", "documents")
    cat.register("export", "csv", files=[path], schemas={"documents": DOCUMENTS_DDL},
                 read_options=sinks.READ_CSV)
    return cat.scan("export", "documents")


def materialise_structure(spark, sf_dir):
    """K2: the structure rows that a materialised copy of orders is stored with."""
    cat = warehouse(spark, sf_dir)
    path = shared_path(spark, "structure", "orders")
    sinks.materialise(cat.scan("warehouse", "orders"), catalog=cat, connection="warehouse", table="orders",
                      structure_path=path)
    return spark.read.parquet(path)


def json_keypaths_deep(spark, sf_dir):
    """T9 on documents of 12 nested levels derived from ``orders`` (the viewer's
    ignored keys among them): the innermost entry, by plain text suffix."""
    o = warehouse(spark, sf_dir).scan("warehouse", "orders")
    doc = F.struct(F.col("o_custkey").alias("leaf"))
    for k in range(11, 0, -1):
        doc = F.struct(doc.alias("comma" if k == 5 else f"l{k}"))
    docs = o.select("o_orderkey", F.to_json(doc).alias("doc"))
    return json_keypaths(docs, "doc", "eaf", match="string_suffix", ignore_keys=IGNORED_KEYS).select(
        "o_orderkey", "path", "value")


def create_from_join(spark, sf_dir):
    """A join across two connections written as a new table."""
    cat = with_crm(spark, sf_dir)
    joined = Worksheet(cat).run(
        "SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment FROM warehouse__orders o "
        "JOIN crm__customer c ON o.o_custkey = c.c_custkey",
        [("crm", "customer"), ("warehouse", "orders")])
    return sinks.create_table(joined, cat, "derived", "orders_customers",
                              path=shared_path(spark, "tables", "orders_customers"))


def json_keypaths_nested(spark, sf_dir):
    """T9 on documents Spark derives from ``orders``: nested objects and an array;
    every entry whose path ends with the segment ``id`` (``suffix`` match)."""
    o = warehouse(spark, sf_dir).scan("warehouse", "orders")
    docs = o.select("o_orderkey", F.to_json(F.struct(
        F.struct(F.col("o_orderkey").alias("id")).alias("key"),
        F.array(F.struct(F.col("o_custkey").alias("id"),
                         F.col("o_orderstatus").alias("status"))).alias("parties"),
        F.col("o_orderpriority").alias("priority"))).alias("doc"))
    return json_keypaths(docs, "doc", "id", match="suffix").select(
        "o_orderkey", "path", "value")


def json_keypaths_combined(spark, sf_dir):
    """T9 with combined leaf text: the ``parties`` array of each derived order
    document, as JSON text and as its leaves joined in order."""
    o = warehouse(spark, sf_dir).scan("warehouse", "orders")
    docs = o.select("o_orderkey", F.to_json(F.struct(
        F.array(F.struct(F.col("o_custkey").alias("id"),
                         F.col("o_orderstatus").alias("status"))).alias("parties"),
        F.col("o_orderpriority").alias("priority"))).alias("doc"))
    return json_keypaths(docs, "doc", "parties", combine=True).select(
        "o_orderkey", "path", "value", "combined")


def search_documents(spark, sf_dir):
    """T5 over whole document texts: any column containing 'license', any case."""
    d = warehouse(spark, sf_dir).scan("warehouse", "documents")
    return shaping.search(d, "License").select("doc_id", "lang", "source", "n_chars")


def filter_documents(spark, sf_dir):
    """P3 + P5 + P6 over whole texts and their source (case-sensitive text)."""
    d = warehouse(spark, sf_dir).scan("warehouse", "documents")
    return apply_filters(d, [FilterSpec("contains", "text", "the", id="t"),
                             FilterSpec("ends with", "text", ".", id="e"),
                             FilterSpec("not contains", "source", "x", id="s")]
                         ).select("doc_id", "lang", "source", "n_chars")


def view_preview(spark, sf_dir):
    """A viewer screen as one plan: two filters, a search, chosen columns, a sort
    and the first 100 rows (P9 + T5 + T3 + T4 + T6 through ``View``)."""
    from vantage.operators.view import View
    li = warehouse(spark, sf_dir).scan("warehouse", "lineitem")
    v = (View(li).filter(FilterSpec("equal", "l_returnflag", "R", id="f"))
         .filter(FilterSpec("starts with", "l_shipdate", "1995", id="d"))
         .search("0.0")
         .select(["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate"])
         .sort(("l_extendedprice", "desc"), "l_orderkey", "l_linenumber"))
    return v.preview(100)


def search_numeric(spark, sf_dir):
    """T5 over number text: '77' in any column of customer (case-sensitive)."""
    c = warehouse(spark, sf_dir).scan("warehouse", "customer")
    return shaping.search(c, "77", case_sensitive=True)


def sort_nulls_preview(spark, sf_dir):
    """T4 + T6: nulls first (explicit), ties broken by key, 100 rows."""
    return shaping.preview(_orders_with_nulls(spark, sf_dir), 100,
                           order=[("o_orderstatus", "asc"), ("o_orderkey", "desc")])


def catalog_restricted(spark, sf_dir):
    """A connection restricted to one table lists only that table."""
    cat = Catalog(spark)
    cat.register("one", "parquet", files=[f"{sf_dir}/{t}.parquet" for t in TPCH],
                 table="lineitem")
    return with_row_counts(spark, cat).select("connection", "source", "table", "n_rows")


def fill_then_not_equal(spark, sf_dir):
    """T1 then P2 the viewer's way: filled nulls are the text 'Null' and stay."""
    filled = shaping.fill_null_token(_orders_with_nulls(spark, sf_dir))
    return apply_filters(filled, [FilterSpec("not equal", "o_orderstatus", "F")])


def export_parquet_json(spark, sf_dir):
    """K4: lineitem exported as Parquet and as JSON lines, both read back typed."""
    cat = warehouse(spark, sf_dir)
    li = cat.scan("warehouse", "lineitem")
    pq = _staged(spark, li, "parquet", "lineitem")
    js = _staged(spark, li, "json", "lineitem")
    back_pq = spark.read.parquet(pq)
    back_js = spark.read.schema(li.schema).json(js)
    return back_pq.unionByName(back_js)


def snapshot_refresh(spark, sf_dir):
    """K1 / S8 with versions: orders in a folder of three files' worth, copied; then the files of the pending
    orders are replaced (prices one higher) and the copy is refreshed. Rows of both versions."""
    from vantage.operators import snapshots
    name = "landed_" + uuid.uuid4().hex[:8]  # a source of its own per call
    root = shared_path(spark, "staged") + "/orders"
    cat = warehouse(spark, sf_dir)
    orders = cat.scan("warehouse", "orders")
    sinks.export(orders, root, fmt="parquet", partition_by="o_orderstatus")
    cat.register(name, "parquet", files=[root])
    first = snapshots.refresh(cat, name, "orders")
    pending = orders.where("o_orderstatus = 'P'").drop("o_orderstatus")
    sinks.export(pending.withColumn("o_totalprice", F.col("o_totalprice") + 1), root + "/o_orderstatus=P", fmt="parquet")
    second = snapshots.refresh(cat, name, "orders")

    def of(version):
        return version.read().select(F.lit(version.number).alias("version"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return of(first).unionByName(of(second))


_BUCKETED: dict[tuple, Catalog] = {}


def _files(spark, path: str) -> tuple:
    """Name, size and time of every file of a table, listed by the path's own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def bucketed_join(spark, sf_dir):
    """K1 with bucketing: orders and lineitem materialised bucketed and sorted on
    the order key, so the join of the copies reads both sides without a shuffle
    (the plan has a sort-merge join and no exchange below it)."""
    key = (session_key(spark), sf_dir, *(_files(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")))
    if key not in _BUCKETED:  # the copies are written once, and again when the files change
        cat = warehouse(spark, sf_dir)
        n = max(sinks.buckets_for(cat.scan("warehouse", t)) for t in ("orders", "lineitem"))
        for t, by in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
            sinks.materialise(cat.scan("warehouse", t), shared_path(spark, "materialised", "bucketed", t),
                              catalog=cat, connection="warehouse", table=t, bucket_by=(n, [by]))
        _BUCKETED[key] = cat
    cat = _BUCKETED[key]
    o, li = cat.scan("warehouse", "orders"), cat.scan("warehouse", "lineitem")
    return (li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
            .groupBy("o_orderstatus", "l_returnflag")
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty")))


def bucketed_hot_join(spark, sf_dir):
    """K1 with a hot key: a third of lineitem moved to one order, both sides bucketed with the hot key spread
    over salts, joined without a shuffle."""
    from vantage.operators import hotkeys
    cat = warehouse(spark, sf_dir)
    o, li = cat.scan("warehouse", "orders"), cat.scan("warehouse", "lineitem")
    first = o.agg(F.min("o_orderkey")).first()[0]
    moved = li.select(F.when(F.col("l_orderkey") % 3 == 0, F.lit(first)).otherwise(F.col("l_orderkey")).alias("o_orderkey"),
                      "l_linenumber", "l_quantity", "l_returnflag")
    left, right = hotkeys.materialise_pair(moved, o.select("o_orderkey", "o_orderstatus"), "o_orderkey", 16)
    return (hotkeys.join_pair(left, right, "o_orderkey").groupBy("o_orderstatus", "l_returnflag")
            .agg(F.count(F.lit(1)).alias("n_lines"),
                 F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty")))


def search_skipping(spark, sf_dir):
    """T5 with a skipping index: documents copied into several files, their trigrams indexed, and the
    search run over the files that may hold the text."""
    from vantage.operators import skipping
    docs = warehouse(spark, sf_dir).scan("warehouse", "documents")
    base = shared_path(spark, "skipping")
    # texts of one source and language lie together, so that files differ in what they hold
    files = max(16, docs.count() // 10_000)
    docs.repartitionByRange(files, "lang", "source", "doc_id").write.parquet(f"{base}/documents")
    index = skipping.build(spark, f"{base}/documents", f"{base}/index", ["text", "lang", "source"])
    found = skipping.search_files(spark, f"{base}/documents", index, "license", ["text", "lang", "source"])
    return found.select("doc_id", "lang", "source", "n_chars")


def uploads_replaced(spark, sf_dir):
    """C8 + K1 over time: orders uploaded as files by status, streamed into a versioned copy; then the files of
    the pending orders are uploaded again (prices one higher) and take the places of the first."""
    from vantage.operators import snapshots
    from vantage.streaming import ingest_replacing, watch
    cat = warehouse(spark, sf_dir)
    orders = cat.scan("warehouse", "orders")
    root = shared_path(spark, "uploads")
    target = f"{root}/copy"
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(root).getFileSystem(spark._jsc.hadoopConfiguration())

    files = max(2, orders.count() // 50_000)

    def upload(number, df, status):
        """Files of stable names, as an upload would have: Spark writes them, and they are put under their names."""
        staged = f"{root}/staged/{number}{status}"
        sinks.export(df.where(F.col("o_orderstatus") == status).repartition(files, "o_orderkey"), staged, fmt="parquet")
        fs.mkdirs(p(f"{root}/orders/{number}"))
        for f in fs.listStatus(p(staged)):
            name = f.getPath().getName()
            if name.startswith("part-"):
                fs.rename(f.getPath(), p(f"{root}/orders/{number}/{status}-{name.split('-')[1]}.parquet"))
    cat.register("uploads", "parquet", files=[f"{root}/orders"])
    for status in ("F", "O", "P"):
        upload(1, orders, status)
    ingest_replacing(watch(cat, "uploads", "orders", schema=orders.schema), target, name=root.rsplit("/", 1)[-1])
    upload(2, orders.withColumn("o_totalprice", F.col("o_totalprice") + 1), "P")
    ingest_replacing(watch(cat, "uploads", "orders", schema=orders.schema), target, name=root.rsplit("/", 1)[-1])
    return snapshots.latest(spark, target).read().select("o_orderkey", "o_orderstatus", "o_totalprice")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_parquet": scan_parquet,
    "scan_csv": scan_csv,
    "scan_json": scan_json,
    "scan_json_payload": scan_json_payload,
    "catalog_tables": catalog_tables,
    "structure": structure,
    "register_connection": register_connection,
    "diagnose": diagnose,
    "diagnose_files": diagnose_files,
    "null_fill": null_fill,
    "flatten_one_level": flatten_one_level,
    "flatten_full": flatten_full,
    "project": project,
    "sort_preview": sort_preview,
    "search_any_column": search_any_column,
    "filter_equal_int": _filtered("part", FilterSpec("equal", "p_size", "7")),
    "filter_equal_double": _filtered("lineitem", FilterSpec("equal", "l_quantity", "23.0")),
    "filter_not_equal": _filtered("orders", FilterSpec("not equal", "o_orderstatus", "F")),
    "filter_contains": _filtered("part", FilterSpec("contains", "p_name", "ing")),
    "filter_not_contains": _filtered("part", FilterSpec("not contains", "p_name", "ing")),
    "filter_starts_with": _filtered("orders", FilterSpec("starts with", "o_orderdate", "1997-01")),
    "filter_ends_with": _filtered("part", FilterSpec("ends with", "p_name", "ring")),
    "filter_null": filter_null,
    "filter_not_null": filter_not_null,
    "filter_null_token": filter_null_token,
    "filter_set": filter_set,
    "filter_removed": filter_removed,
    "filter_like_mode": _filtered("part", FilterSpec("contains", "p_name", "s%ing", mode="like")),
    "calculated_column": calculated_column,
    "json_keypaths": json_keypaths_query,
    "json_keypaths_nested": json_keypaths_nested,
    "json_keypaths_combined": json_keypaths_combined,
    "json_keypaths_deep": json_keypaths_deep,
    "search_numeric": search_numeric,
    "search_documents": search_documents,
    "view_preview": view_preview,
    "filter_documents": filter_documents,
    "sort_nulls_preview": sort_nulls_preview,
    "catalog_restricted": catalog_restricted,
    "fill_then_not_equal": fill_then_not_equal,
    "export_parquet_json": export_parquet_json,
    "filter_equal_timestamp": _filtered("orders", FilterSpec("equal", "o_orderdate",
                                                             "1996-01-02 00:00:00")),
    "filter_starts_with_int": _filtered("part", FilterSpec("starts with", "p_size", "1")),
    "worksheet_cross_source": worksheet_cross_source,
    "worksheet_same_name": worksheet_same_name,
    "materialise_roundtrip": materialise_roundtrip,
    "materialise_structure": materialise_structure,
    "export_csv": export_csv,
    "export_documents_csv": export_documents_csv,
    "bucketed_join": bucketed_join,
    "snapshot_refresh": snapshot_refresh,
    "bucketed_hot_join": bucketed_hot_join,
    "search_skipping": search_skipping,
    "uploads_replaced": uploads_replaced,
    "create_from_join": create_from_join,
}
for _name in WORKSHEET_SQL:
    QUERIES[_name] = (lambda n: lambda spark, sf_dir: _ws(spark, sf_dir, n))(_name)


# -- flagship -------------------------------------------------------------------------------

FLAGSHIP_SQL = (
    "SELECT r.r_name, n.n_name, COUNT(*) AS n_lines, "
    "CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue "
    "FROM warehouse__lineitem l JOIN open_orders o ON l.l_orderkey = o.o_orderkey "
    "JOIN crm__customer c ON o.o_custkey = c.c_custkey "
    "JOIN warehouse__nation n ON c.c_nationkey = n.n_nationkey "
    "JOIN warehouse__region r ON n.n_regionkey = r.r_regionkey "
    "GROUP BY r.r_name, n.n_name")


def flagship(spark, sf_dir):
    """Tier-0 slice end to end: a viewer filter on parquet ``orders`` feeds a
    worksheet that joins it with parquet ``lineitem``/``nation``/``region`` and a
    CSV copy of ``customer`` from a second connection, then aggregates."""
    cat = with_crm(spark, sf_dir)
    ws = Worksheet(cat)
    orders = apply_filters(cat.scan("warehouse", "orders"),
                           [FilterSpec("equal", "o_orderstatus", "O", id="status")])
    ws.add_frame("open_orders", orders)
    return ws.run(FLAGSHIP_SQL)


QUERIES["flagship"] = flagship
