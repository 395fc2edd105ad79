"""SQL worksheet (W1-W4): tables from any connections become views, a read-only
guard checks the text with Spark's own parser, and ``spark.sql`` returns a
lazy DataFrame, so joins across connections are planned by Catalyst (broadcast
only under ``spark.sql.autoBroadcastJoinThreshold``, AQE skew handling on).
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession

from vantage.session import session_key

VIEW_SEP = "__"


class ReadOnlyViolation(ValueError):
    pass


# Logical-plan node classes that only read (describe, show, explain).
_READ_COMMAND = re.compile(r"^(Describe|Show|Explain)")
# Nodes that are neither a Command nor a parsed statement yet still write or run
# code; they must be named explicitly.
_ALWAYS_REJECT = ("Call", "UnresolvedExecuteImmediate", "InsertIntoDir", "InsertIntoStatement",
                  "CompoundBody", "SingleStatement", "SetCommand", "ResetCommand")
# Functions that call arbitrary static JVM methods: code, not a read.
_CODE_FUNCTIONS = ("reflect", "java_method", "try_reflect")
_CODE_WORDS = re.compile("reflect|java_method|identifier", re.I)
# Sources that can stand before a path in a FROM clause.
_PATH_SOURCES = ("csv", "parquet", "json", "orc", "text", "xml", "avro", "binaryfile", "delta", "jdbc",
                 "org.apache.spark.sql.parquet")


_CHAINS: dict[str, list[str]] = {}


def _class_chain(node) -> list[str]:
    """Simple names of the node's class, its superclasses and every interface
    they implement (transitively); the node's own class comes first. Cached per
    class, so a plan costs a few JVM calls per node."""
    cls = node.getClass()
    key = cls.getName()
    if key not in _CHAINS:
        _CHAINS[key] = _chain_of(cls)
    return _CHAINS[key]


def _chain_of(first) -> list[str]:
    names, seen = [], set()
    todo = [first]
    while todo:
        cls = todo.pop(0)
        if cls is None:
            continue
        name = cls.getName()
        if name in seen:
            continue
        seen.add(name)
        names.append(cls.getSimpleName())
        todo.append(cls.getSuperclass())
        todo.extend(cls.getInterfaces())
    return names


def _walk(root):
    """Every node of a parsed plan in pre-order, subquery plans included
    (iterative, so a very deep plan does not hit Python's recursion limit)."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        nxt = []
        it = node.children().iterator()
        while it.hasNext():
            nxt.append(it.next())
        if node.getClass().getSimpleName() == "ExplainCommand":
            nxt.append(node.logicalPlan())
        # CTE definitions are inner children
        for more in (node.innerChildren, node.subqueries):
            it = more().iterator()
            while it.hasNext():
                child = it.next()
                if "LogicalPlan" in _class_chain(child):
                    nxt.append(child)
        todo.extend(reversed(nxt))


def _calls_code(node) -> bool:
    """True if an expression of the node calls a function that runs arbitrary
    JVM methods, or one whose name is computed."""
    todo = []
    it = node.expressions().iterator()
    while it.hasNext():
        todo.append(it.next())
    while todo:
        e = todo.pop()
        name = e.getClass().getSimpleName()
        if name == "UnresolvedFunction" and e.nameParts().last().lower() in _CODE_FUNCTIONS:
            return True
        if "WithUnresolvedIdentifier" in name:
            return True
        it = e.children().iterator()
        while it.hasNext():
            todo.append(it.next())
    return False


def analyse(spark: SparkSession, query: str) -> tuple[bool, list[str]]:
    """``(read_only, relation names)`` of a query from ONE parse and ONE walk of
    its tree with the session's SQL parser (nothing runs).

    Read-only rejects any node that is a command or parsed statement other than
    DESCRIBE/SHOW/EXPLAIN, the write/run nodes that are not commands (CALL,
    EXECUTE IMMEDIATE, INSERT OVERWRITE DIRECTORY), scripting blocks, reflection
    functions and computed identifiers, and relations that name a path
    (``csv.`/a/b` ``); a parse error is not read-only, and neither is anything
    where the session has no parser to ask (Spark Connect). Relation names are ``a`` or
    ``conn__a``, without the names that the query itself defines (CTEs).
    """
    try:
        parser = spark._jsparkSession.sessionState().sqlParser()
        plan = parser.parsePlan(query)
    except Exception:
        return False, []
    # DESCRIBE / SHOW / EXPLAIN: they print, whatever is inside
    prints = bool(_READ_COMMAND.match(plan.getClass().getSimpleName()))
    look = bool(_CODE_WORDS.search(query))  # the names can be spelled in no other way
    read_only, names, own = True, [], set()
    for node in _walk(plan):
        chain = _class_chain(node)
        name = chain[0]
        if name in ("UnresolvedRelation", "UnresolvedTableOrView", "UnresolvedTable", "UnresolvedView"):
            parts = node.multipartIdentifier()
            parts = [parts.apply(k) for k in range(parts.size())]
            if len(parts) == 1:
                names.append(parts[0])
            elif parts[0].lower() in _PATH_SOURCES or re.search(r"[/:]", parts[-1]):
                read_only = False
        elif name == "UnresolvedWith":
            ctes = node.cteRelations()
            own.update(ctes.apply(k)._1().lower() for k in range(ctes.size()))
        elif "WithUnresolvedIdentifier" in name:
            read_only = False
        if look and _calls_code(node):
            read_only = False
        if prints:
            continue
        if name in _ALWAYS_REJECT:
            read_only = False
        writes = any(c in ("Command", "ParsedStatement", "V2CreateTablePlan",
                           "V2WriteCommand") or c.endswith("Command") for c in chain)
        if writes and not _READ_COMMAND.match(name):
            read_only = False
    return read_only, [n for n in dict.fromkeys(names) if n.lower() not in own]


def check_read_only(spark: SparkSession, query: str) -> bool:
    """True when ``query`` is one statement that only reads (see ``analyse``)."""
    return analyse(spark, query)[0]


def referenced_tables(spark: SparkSession, query: str) -> list[str]:
    """Relation names the query reads (see ``analyse``)."""
    return analyse(spark, query)[1]


def view_name(connection: str, table: str) -> str:
    return f"{connection}{VIEW_SEP}{table}"


class AmbiguousTable(ValueError):
    pass


# Views that worksheets made, by session: a name that the running worksheet does
# not know must not find another catalog's table.
_MADE: dict[str, set[str]] = {}


class Worksheet:
    """Run read-only SQL over tables of one or more connections."""

    def __init__(self, catalog):
        self.catalog = catalog
        self.spark = catalog.spark
        self._frames: set[str] = set()
        self._reduced: dict[tuple[str, str], DataFrame] = {}

    def reduce(self, connection: str, table: str, column: str, keys: str | DataFrame) -> None:
        """From now on this worksheet reads of the table only rows whose ``column`` is among ``keys`` (a query
        or DataFrame of one column, evaluated now): pushed into the table's scan, so a database sends
        no others. For tables that an inner or semi join on that column ties to those keys."""
        from vantage.plans.reduction import reduced
        found = self.run(keys) if isinstance(keys, str) else keys
        self._reduced[connection, table] = reduced(self.catalog.scan(connection, table), column, found)

    def register(self, tables: Iterable[tuple[str, str]]) -> dict[str, str]:
        """A view ``connection__table`` per table, plus the bare table name when
        only one requested connection has it (W2). Returns view -> source."""
        tables = list(dict.fromkeys(tables))
        counts = Counter(t for _, t in tables)
        made = {}
        for conn, table in tables:
            df = self._reduced.get((conn, table))
            if df is None:
                df = self.catalog.scan(conn, table)
            full = view_name(conn, table)
            df.createOrReplaceTempView(full)
            made[full] = f"{conn}.{table}"
            if counts[table] == 1:
                df.createOrReplaceTempView(table)
                made[table] = f"{conn}.{table}"
        mine = _MADE.setdefault(session_key(self.spark), set())
        for stale in mine - {m.lower() for m in made}:
            self.spark.catalog.dropTempView(stale)
        mine.clear()
        mine.update(m.lower() for m in made)
        return made

    def resolve(self, query: str, names: list[str] | None = None) -> list[tuple[str, str]]:
        """The (connection, table) pairs a query names, as ``conn__table`` or as a
        bare table name that exactly one connection has; one that several have
        raises ``AmbiguousTable``. Names match without regard to case, as Spark
        SQL identifiers do."""
        if names is None:
            names = referenced_tables(self.spark, query)
        owners: dict[str, list[tuple[str, str]]] = {}
        for conn in self.catalog.connections:
            for t in self.catalog.table_names(conn.name):
                owners.setdefault(t.lower(), []).append((conn.name, t))
        found = []
        for name in names:
            if VIEW_SEP in name:
                conn, table = name.split(VIEW_SEP, 1)
                found.extend(p for p in owners.get(table.lower(), [])
                             if p[0].lower() == conn.lower())
            elif name.lower() in self._frames:
                continue
            elif len(owners.get(name.lower(), [])) == 1:
                found.append(owners[name.lower()][0])
            elif owners.get(name.lower()):
                raise AmbiguousTable(f"table {name!r} is in several connections; write one of " + ", ".join(
                    view_name(*p) for p in owners[name.lower()]))
        return list(dict.fromkeys(found))

    def add_frame(self, name: str, df: DataFrame) -> None:
        """Expose an already shaped DataFrame (e.g. a filtered table) by name."""
        self._frames.add(name.lower())
        _MADE.get(session_key(self.spark), set()).discard(name.lower())
        df.createOrReplaceTempView(name)

    def run(self, query: str, tables: Iterable[tuple[str, str]] | None = None) -> DataFrame:
        """Guard, register the tables (those the query names when
        ``tables`` is None), then ``spark.sql`` (lazy)."""
        read_only, names = analyse(self.spark, query)
        if not read_only:
            raise ReadOnlyViolation("only read-only queries (SELECT, WITH, VALUES, TABLE, "
                                    "DESCRIBE, SHOW, EXPLAIN) may run in a worksheet")
        self.register(self.resolve(query, names) if tables is None else tables)
        return self.spark.sql(query)

    def save(self, query: str, path: str, fmt: str = "csv",
             tables: Iterable[tuple[str, str]] | None = None, **options) -> str:
        """Run the query and export its result (K3): a distributed write, one
        file per task; nothing is collected."""
        from vantage.operators.sinks import export
        return export(self.run(query, tables), path, fmt=fmt, **options)

    def run_safe(self, query: str, tables: Iterable[tuple[str, str]] | None = None):
        """``(DataFrame, None)`` or ``(None, error text)``. The plan is
        analysed here, so unknown tables and columns are reported as errors."""
        try:
            df = self.run(query, tables)
            df.schema  # force analysis
            return df, None
        except Exception as e:  # noqa: BLE001 - any failure becomes the error text
            return None, _error_text(e)


def _error_text(e: Exception) -> str:
    text = str(e).strip()
    first = text.splitlines()[0] if text else type(e).__name__
    return first
