"""Queries over the driver's tables for what is not one operator: transactions, errors, text forms, backup, live queries over time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .errors import ConflictError, GraphError, TransactionDone
from .cypher import CypherSyntaxError
from .runtime import shared_folder
from .session import GraphSession
from .sources.rows import canonical
from .sources.store import Store
from .sources.trade import trade_graph
from .types import CypherTypeError

Query = Callable[[SparkSession, str], DataFrame]
#: query: SQL
SURFACE: dict[Query, str] = {}


def _sql(text: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        SURFACE[f] = text
        return f

    return keep


def _customers(spark: SparkSession, sf_dir: str, store: Store | str | None = None) -> GraphSession:
    """All customers as a written graph, each with the number of its nation."""
    g = GraphSession(spark, store)
    g.import_rows("UNWIND $rows AS r CREATE (:C {k: r.c_custkey, nation: r.c_nationkey, bal: r.c_acctbal})", spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return g


def _read_only(spark: SparkSession, sf_dir: str) -> GraphSession:
    return GraphSession(spark, trade_graph(spark, sf_dir))


def _rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# Functions without a value of their own.


@_sql("SELECT p_partkey AS k, sqrt(p_retailprice * p_retailprice) AS a, sqrt(p_size)::DOUBLE AS b FROM part")
def fn_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_only(spark, sf_dir).query("MATCH (p:Part) RETURN p.partkey AS k, sqrt(p.retailprice * p.retailprice) AS a, sqrt(p.size) AS b")


@_sql("SELECT n_regionkey::BIGINT AS r, count(*) AS n, true AS inside, true AS late, 1::BIGINT AS moments FROM nation GROUP BY 1")
def fn_chance_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_only(spark, sf_dir).query("MATCH (n:Nation) WITH n.regionkey AS r, rand() AS x, timestamp() AS t RETURN r, count(*) AS n, min(x) >= 0 AND max(x) < 1 AS inside, min(t) > 1500000000000 AS late, count(DISTINCT t) AS moments")


@_sql("SELECT e.event_id AS k, coalesce(e.value, 0) AS v, 'it''s' AS s, 5::BIGINT AS \"match\" FROM events e")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, names in backticks, escapes, and keywords as names."""
    return _read_only(spark, sf_dir).query("MATCH (`a node`:Event) // all of them\nRETURN `a node`.event_id AS k, /* null\n as zero */ coalesce(`a node`.value, 0.0) AS v, 'it\\'s' AS s, 5 AS match")


@_sql("SELECT unnest(['n.name', 'count(*)', 'n.k + 1', 'labels(n)[0]']) AS name")
def unaliased_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = GraphSession(spark).query("MATCH (n:N) RETURN n.name, count(*), n.k + 1, labels(n)[0]")
    return _rows(spark, [(c,) for c in df.columns], "name string")


REFUSED = {
    "undefined variable": "MATCH (n) RETURN m",
    "WITH needs a name": "MATCH (n) WITH n.k RETURN 1",
    "WITH hides what it leaves out": "MATCH (n) WITH n.k AS k RETURN n",
    "RETURN ends a query": "RETURN 1 AS x MATCH (n) RETURN n",
    "a query ends in RETURN or a write": "MATCH (n)",
    "RETURN * without variables": "RETURN *",
    "nested aggregate": "MATCH (n) RETURN count(sum(n.k))",
    "aggregate in WHERE": "MATCH (n) WHERE count(n) > 1 RETURN n",
    "columns of UNION": "RETURN 1 AS a UNION RETURN 2 AS b",
    "duplicate columns": "RETURN 1 AS a, 2 AS a",
    "sort key after DISTINCT": "MATCH (n) RETURN DISTINCT n.a AS a ORDER BY n.b",
    "properties of a walk": "MATCH (a)-[r*1..2 {k: 1}]->(b) RETURN a",
    "shortest path of unbound ends": "MATCH p = shortestPath((a)-[*]->(b)) RETURN p",
    "WHERE on a shortest path": "MATCH (a), (b), p = shortestPath((a)-[*]->(b)) WHERE length(p) > 1 RETURN p",
    "relationship without direction": "CREATE (a)-[:T]-(b)",
    "relationship of two types": "CREATE (a)-[:T|U]->(b)",
    "MERGE with null": "MERGE (n:N {k: null})",
    "missing parameter": "RETURN $none",
    "wrong type": "RETURN 1 + 'a'",
    "STREAM as a plain query": "STREAM MATCH (n) RETURN n",
    "too many rows": "UNWIND range(1, 9) AS x RETURN x",
    "schema command beside others": "MATCH (n) CREATE INDEX FOR (n:N) ON (n.k)",
}


@_sql("SELECT unnest([" + ", ".join("'" + k.replace("'", "''") + "'" for k in REFUSED) + "]) AS \"case\", true AS refused")
def refused_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of the language refuse, each before anything runs but for the limit of rows."""
    g, out = GraphSession(spark), []
    for case, text in REFUSED.items():
        try:
            g.query(text, max_rows=8 if case == "too many rows" else None)
            out.append((case, False))
        except (CypherSyntaxError, CypherTypeError, GraphError):
            out.append((case, True))
    return _rows(spark, out, "case string, refused boolean")


# Writes over time.


@_sql("SELECT count(*) AS n, count(*) AS seen, 0::BIGINT AS rolled_back, true AS ended FROM customer")
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction sees its own writes, others do not; one that fails leaves nothing; one that has ended is of no use."""
    g = GraphSession(spark)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")

    def write(tx):
        tx.query("UNWIND $rows AS r CREATE (:C {k: r.c_custkey})", {"rows": customers})
        seen.append(tx.query("MATCH (c:C) RETURN count(*) AS n").first()["n"])
        outside.append(g.query("MATCH (c:C) RETURN count(*) AS n").first()["n"])
        return tx

    seen: list[int] = []
    outside: list[int] = []
    tx = g.update(write)

    def fail(tx):
        tx.query("CREATE (:Gone)")
        raise KeyError("stop")

    try:
        g.update(fail)
    except KeyError:
        pass
    try:
        tx.query("RETURN 1 AS x")
        ended = False
    except TransactionDone:
        ended = outside == [0]
    return g.query("MATCH (c:C) WITH count(*) AS n OPTIONAL MATCH (x:Gone) RETURN n, $seen AS seen, count(x) AS rolled_back, $ended AS ended", {"seen": seen[0], "ended": ended})


@_sql("SELECT count(*) + 2 AS n, 2::BIGINT AS attempts, true AS conflict FROM customer")
def optimistic_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer that another one overtakes runs again on the new version; a commit on an old version is a conflict."""
    g = _customers(spark, sf_dir)
    other = GraphSession(spark, g.store.path)
    old = g.store.snapshot()
    attempts = []

    def write(tx):
        attempts.append(1)
        tx.query("CREATE (:C {k: -1})")
        if len(attempts) == 1:
            other.query("CREATE (:C {k: -2})")

    g.update(write)
    try:
        g.store.commit(old, old)
        conflict = False
    except ConflictError:
        conflict = True
    return g.query("MATCH (c:C) RETURN count(*) AS n, $a AS attempts, $c AS conflict", {"a": len(attempts), "c": conflict})


@_sql("SELECT c_custkey AS k, c_acctbal AS bal, CASE WHEN c_nationkey = 3 THEN 'low' END AS tag FROM customer WHERE c_nationkey <> 7")
def commits_by_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small commits on a large table, read from its base and what has changed since."""
    g = _customers(spark, sf_dir)
    g.query("MATCH (c:C) WHERE c.nation = 3 SET c.tag = 'low'")
    g.query("MATCH (c:C) WHERE c.nation = 5 SET c.tag = 'high'")
    g.query("MATCH (c:C) WHERE c.nation = 7 DELETE c")
    g.query("MATCH (c:C) WHERE c.nation = 5 REMOVE c.tag")
    return g.query("MATCH (c:C) RETURN c.k AS k, c.bal AS bal, c.tag AS tag")


@_sql("SELECT c_custkey AS k, c_acctbal AS bal, c_custkey = 1 AS first FROM customer")
def backup_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _customers(spark, sf_dir)
    copy = g.store.backup(f"{shared_folder(spark)}/graphloom/backup-{uuid.uuid4().hex}")
    g.query("MATCH (c:C) DELETE c")
    return GraphSession(spark, copy.path).query("MATCH (c:C) RETURN c.k AS k, c.bal AS bal, c.k = 1 AS first")


@_sql("""SELECT '{"k":' || n_nationkey || ',"m":{"a":null,"z":"' || r_name || '"},"name":"' || n_name || '"}' AS "row" FROM nation JOIN region ON n_regionkey = r_regionkey""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.nationkey AS k, {z: r.name, a: null} AS m, n.name AS name"
    return canonical(_read_only(spark, sf_dir).query(q)).select("row")


@_sql("SELECT count(*) AS n, count(*) AS written, 1::BIGINT AS labels FROM customer")
def writes_under_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A LIMIT above a write does not limit what is written; a label that is named twice is one."""
    g = _customers(spark, sf_dir)
    g.query("MATCH (c:C) SET c.seen = true RETURN c.k LIMIT 3")
    g.query("CREATE (:Twice:Twice {k: 1})")
    return g.query("MATCH (c:C) WITH count(*) AS n, count(c.seen) AS written MATCH (t:Twice) RETURN n, written, size(labels(t)) AS labels")


# Text forms of plans and results.


@_sql("SELECT * FROM (VALUES (0, 'Limit(5)'), (1, '  Sort(k)'), (2, '    Project([c.k AS k])'), (3, '      Filter(c.nation = 3)'), (4, '        Expand(c)-[_r0:T]->(d)'), (5, '          NodeByProperty(c:C {nation = 3})')) t(line, text)")
def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphSession(spark)
    g.query("CREATE INDEX FOR (c:C) ON (c.nation)")
    text = g.explain("MATCH (c:C {nation: 3})-[:T]->(d) RETURN c.k AS k ORDER BY k LIMIT 5")
    return _rows(spark, list(enumerate(text.splitlines())), "line int, text string")


@_sql("SELECT * FROM (SELECT row_number() OVER (ORDER BY r_name)::INTEGER AS line, r_name AS text FROM region) UNION ALL SELECT 0, 'name' UNION ALL SELECT (count(*) + 1)::INTEGER, '(' || count(*) || ' rows)' FROM region")
def shell_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out: list[str] = []
    cli.loop(_read_only(spark, sf_dir), ["MATCH (r:Region)\n", "RETURN r.name AS name ORDER BY name;\n", ":quit\n"], out.append)
    return _rows(spark, list(enumerate("\n".join(out).splitlines())), "line int, text string")


# Live queries over time.


@_sql("SELECT * FROM (VALUES (0, 'initial', 'none'), (1, 'skipped', 'another label'), (2, 'skipped', 'another key'), (3, 'anchored', 'a key that is read'), (4, 'full', 'more nodes than the limit')) t(step, mode, change)")
def live_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a live query follows changes that do not concern it, a few nodes, and more than 4,096."""
    g = GraphSession(spark)
    g.query("UNWIND range(1, 4097) AS i CREATE (:C {k: i})")
    live = g.subscribe("MATCH (c:C) RETURN c.k AS k")
    steps = [("none", None), ("another label", "CREATE (:Other)"), ("another key", "MATCH (c:C {k: 1}) SET c.unread = 1"), ("a key that is read", "MATCH (c:C {k: 1}) SET c.k = 0"), ("more nodes than the limit", "MATCH (c:C) SET c.k = c.k + 1")]
    out = []
    for i, (what, text) in enumerate(steps):
        if text:
            g.query(text)
        live.poll()
        out.append((i, live.mode, what))
    return _rows(spark, out, "step int, mode string, change string")


@_sql("SELECT n_nationkey::BIGINT AS nation, count(c_custkey) AS n, 'added' AS change FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey = 4 GROUP BY 1")
def live_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live query with a checkpoint is closed, and another session's goes on with what changed in between."""
    where = f"{shared_folder(spark)}/graphloom/live-{uuid.uuid4().hex}"
    q = "MATCH (c:C) WHERE c.tag = 'new' RETURN c.nation AS nation, count(*) AS n"
    g = _customers(spark, sf_dir)
    first = g.subscribe(q, checkpoint=where)
    first.poll()
    first.close()
    g.query("MATCH (c:C) WHERE c.nation = 4 SET c.tag = 'new'")
    c = GraphSession(spark, g.store.path).subscribe(q, checkpoint=where).poll()
    return c.added.withColumn("change", F.lit("added")).unionByName(c.removed.withColumn("change", F.lit("removed")))


@_sql("SELECT true AS limited, true AS ended")
def live_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that outgrows its limit ends a live query."""
    g = GraphSession(spark)
    g.query("UNWIND range(1, 3) AS i CREATE (:C {k: i})")
    live = g.subscribe("MATCH (c:C) RETURN c.k AS k", max_rows=3)
    live.poll()
    g.query("CREATE (:C {k: 4})")
    try:
        live.poll()
        limited = False
    except GraphError:
        limited = True
    return _rows(spark, [(limited, live.error is not None)], "limited boolean, ended boolean")
