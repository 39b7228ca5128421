"""Stores: write clauses, transactions, constraints, import."""

import pytest
from pyspark.sql import functions as F

from graphloom.errors import ConflictError, ConstraintViolation, NodeHasRelationships, ReadOnlyError, SchemaError, TransactionDone
from graphloom.session import GraphSession
from graphloom.sources.store import Store
from graphloom.types import CypherTypeError, plain


def rows(session, q, **params):
    return [tuple(r) for r in session.query(q, params).collect()]


@pytest.fixture(scope="module")
def g(spark):
    g = GraphSession(spark)
    g.query("CREATE (a:P {name: 'a', age: 1})-[:K {w: 1}]->(b:P:Q {name: 'b', age: 2.5, none: null}), (:P {name: 'c'})")
    return g


def test_life_of_a_graph(g):
    assert rows(g, "MATCH (n:P) RETURN n.name, n.age, labels(n) ORDER BY n.name") == [("a", 1.0, ["P"]), ("b", 2.5, ["P", "Q"]), ("c", None, ["P"])]
    assert rows(g, "MATCH (a {name: 'a'}), (c {name: 'c'}) CREATE (a)-[r:K {w: 2}]->(c) RETURN type(r), r.w") == [("K", 2)]
    assert rows(g, "MATCH (n:P) SET n.x = n.age * 2, n:Z, n.y = n.x RETURN n.name, n.x, n.y, n:Z ORDER BY n.name") == [("a", 2.0, 2.0, True), ("b", 5.0, 5.0, True), ("c", None, None, True)]
    assert rows(g, "MATCH (n {name: 'b'}) SET n += {age: null, z: 'q'} REMOVE n:Z, n.x RETURN n.age, n.z, n.x, labels(n)") == [(None, "q", None, ["P", "Q"])]
    with pytest.raises(NodeHasRelationships):
        g.query("MATCH (n {name: 'a'}) DELETE n")
    assert rows(g, "MATCH (n {name: 'a'}) DETACH DELETE n") == []
    assert rows(g, "MATCH (n) OPTIONAL MATCH (n)-[r]-() RETURN count(DISTINCT n), count(r)") == [(2, 0)]


def test_merge(spark):
    g = GraphSession(spark)
    q = "UNWIND $rows AS r MERGE (u:U {k: r.k}) ON CREATE SET u.n = r.n, u.c = 1 ON MATCH SET u.c = u.c + 1"
    g.query(q, {"rows": [{"k": 1, "n": "x"}, {"k": 2, "n": "y"}, {"k": 1, "n": "z"}]})
    assert rows(g, "MATCH (u:U) RETURN u.k, u.c ORDER BY u.k") == [(1, 2), (2, 1)]
    g.query("MATCH (a:U {k: 1}), (b:U {k: 2}) MERGE (a)-[:R]->(b) MERGE (a)-[:R]->(b) MERGE (b)-[:S]->(:New {of: 2})")
    assert rows(g, "MATCH (a)-[r]->(b) RETURN type(r) AS t, b.of AS o ORDER BY t") == [("R", None), ("S", 2)]
    with pytest.raises(CypherTypeError):
        g.query("MERGE (:U {k: null})")


def test_constraints_and_indexes(spark):
    g = GraphSession(spark)
    g.query("CREATE (:U {k: 1}), (:U {k: 2}), (:U {}), (:U {})")
    g.query("CREATE CONSTRAINT FOR (u:U) REQUIRE u.k IS UNIQUE")
    with pytest.raises(ConstraintViolation):
        g.query("CREATE (:U {k: 1})")
    assert rows(g, "MATCH (u:U) RETURN count(*)") == [(4,)]
    assert rows(g, "SHOW CONSTRAINTS") == [("constraint_U_k", "U", "k", "UNIQUE")]
    with pytest.raises(SchemaError):
        g.query("DROP INDEX index_U_k")
    g.query("CREATE INDEX r FOR ()-[x:T]-() ON (x.w)")
    assert rows(g, "SHOW INDEXES") == [("index_U_k", "U", "k", "NODE"), ("r", "T", "w", "RELATIONSHIP")]
    g.query("DROP CONSTRAINT constraint_U_k")
    assert rows(g, "SHOW INDEXES") == [("r", "T", "w", "RELATIONSHIP")]
    g.query("DROP INDEX nope IF EXISTS")
    with pytest.raises(SchemaError):
        g.query("DROP INDEX nope")


def test_transactions(spark):
    g = GraphSession(spark)

    def change(tx):
        tx.query("CREATE (:A {k: 1})")
        assert tx.query("MATCH (a:A) RETURN count(*)").first()[0] == 1
        assert rows(g, "MATCH (a:A) RETURN count(*)") == [(0,)]
        return tx

    tx = g.update(change)
    assert rows(g, "MATCH (a:A) RETURN count(*)") == [(1,)]
    with pytest.raises(TransactionDone):
        tx.query("RETURN 1")
    with pytest.raises(ReadOnlyError):
        g.view(lambda tx: tx.query("CREATE (:B)"))
    with pytest.raises(ValueError):
        g.update(lambda tx: (tx.query("CREATE (:B)"), (_ for _ in ()).throw(ValueError())))
    assert rows(g, "MATCH (b:B) RETURN count(*)") == [(0,)]


def test_conflict_and_persistence(spark, tmp_path):
    path = str(tmp_path / "store")
    g = GraphSession(spark, path)
    store = Store(spark, path)
    old = store.snapshot()
    g.query("CREATE (:A {k: 'v'})")
    with pytest.raises(ConflictError):
        store.commit(old, old)
    assert rows(GraphSession(spark, path), "MATCH (a:A) RETURN a.k") == [("v",)]
    assert store.snapshot(old.version).nodes.df.isEmpty()


def test_commits_write_what_they_change(spark, tmp_path):
    """Deltas of any number give what a rewrite gives; a commit of one change writes few rows."""
    g = GraphSession(spark, str(tmp_path / "store"))
    g.query("UNWIND range(0, 199) AS i CREATE (:A {k: i})-[:T {w: i}]->(:B {k: i})")
    want = {i: i for i in range(200)}
    for i in range(12):
        g.query(f"MATCH (a:A {{k: {i}}}) SET a.v = {i * 10}")
        m = g.store._manifest(g.store.latest())
        assert len(m["nodes"]) <= 9 and sum(s["n"] for s in m["nodes"][1:]) <= 20 and len(m["rels"]) == 1
        want[i] = i * 10
    g.query("MATCH (a:A {k: 3})-[r:T]->(b) DELETE r")
    g.query("MATCH (a:A {k: 4}) DETACH DELETE a")
    g.query("MATCH (a:A {k: 5}) SET a.v = 'text', a:C")
    got = rows(g, "MATCH (a:A) WHERE a.k < 12 RETURN a.k, a.v, a:C ORDER BY a.k")
    assert [(k, plain(v), c) for k, v, c in got] == [(i, "text" if i == 5 else i * 10, i == 5) for i in range(12) if i != 4]
    assert rows(g, "MATCH (:A)-[r:T]->(:B) RETURN count(*), sum(r.w)") == [(198, 19900 - 7)]
    assert rows(GraphSession(spark, str(tmp_path / "store")), "MATCH (n) RETURN count(*)") == [(399,)]
    old = g.store.snapshot(2)
    assert old.nodes.df.count() == 400 and old.rels.df.count() == 200
    log = g.store.changed_since(1, g.store.latest())
    assert log.where("entity = 'node'").count() == 12 + 1 + 1 and log.where("entity = 'rel'").count() == 2


def test_an_index_lays_the_table_out(spark):
    """Files hold ranges of the indexed key, and a seek reaches them as a filter; rows without the key are spread as well."""
    g = GraphSession(spark)
    g.query("UNWIND range(0, 2999) AS i CREATE (:A {k: (i * 7919) % 3000, w: i}) CREATE (:B {w: i})")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        g.query("CREATE INDEX FOR (a:A) ON (a.k)")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (segment,) = g.store._manifest(g.store.latest())["nodes"]
    c = segment["props"]["k"][0]
    files = spark.read.parquet(segment["rows"]).groupBy(F.input_file_name()).agg(F.min(c).alias("a"), F.max(c).alias("b"), F.count("*").alias("n")).collect()
    ranges = sorted((r["a"], r["b"]) for r in files if r["a"] is not None)
    assert len(files) >= 3 and all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:])) and max(r["n"] for r in files) < 4000
    df = g.query("MATCH (a:A {k: 77}) RETURN a.w AS w")
    assert f"EqualTo({c},77)" in df._jdf.queryExecution().toString() and df.count() == 1
    assert rows(g, "MATCH (a:A) WHERE a.k >= 10 AND a.k < 13 RETURN count(*)") == [(3,)]
    assert rows(g, "MATCH (n) RETURN count(*), count(n.k), sum(n.w)") == [(6000, 3000, 2 * 2999 * 1500)]


def test_limits_and_outcomes(spark, monkeypatch):
    from graphloom import errors
    from graphloom.runtime import Folder

    g = GraphSession(spark, Store(spark, max_rows=5))
    with pytest.raises(errors.TransactionTooLarge):
        g.query("UNWIND range(0, 9) AS i CREATE (:A {k: i})")
    g.query("CREATE (:A {k: 1})")
    monkeypatch.setattr(Folder, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(errors.WriteOutcomeUnknown):
        g.query("CREATE (:A {k: 2})")
    monkeypatch.undo()
    assert rows(g, "MATCH (a:A) RETURN count(*)") == [(1,)]
    for text, kind in (("9223372036854775807 + a.k", errors.IntegerOverflow), ("a.k / 0", errors.DivisionByZero), ("a.k % 0", errors.DivisionByZero)):
        with pytest.raises(kind), errors.kinds():
            g.query(f"MATCH (a:A) RETURN {text} AS x").collect()


def test_import(spark):
    g = GraphSession(spark)
    r = g.import_rows("UNWIND $rows AS r CREATE (:N {k: r.k})", [{"k": i} for i in range(25)], batch=20)
    assert (r.rows, r.batches) == (25, 2)
    r = g.import_rows("UNWIND $rows AS r CREATE (:N {k: r.id})", spark.range(100, 200))
    assert r.rows == 100 and rows(g, "MATCH (n:N) RETURN count(*), sum(n.k)") == [(125, 300 + 14950)]


def test_property_types_widen(spark):
    g = GraphSession(spark)
    g.query("CREATE (:A {k: 1, l: []})")
    g.query("CREATE (:A {k: 2.5, l: ['x']})")
    assert sorted(rows(g, "MATCH (a:A) RETURN a.k")) == [(1.0,), (2.5,)]
    g.query("CREATE (:A {k: 'x'})")
    assert g.query("MATCH (a:A) WHERE a.k = 'x' OR a.k = 1 RETURN count(*) AS n").first()["n"] == 2
    g.query("CREATE (:A {k: [1]})")
    assert sorted((str(plain(r[0])) for r in rows(g, "MATCH (a:A) RETURN a.k"))) == ["1.0", "2.5", "[1]", "x"]


def test_entities_as_parameters_backup_and_canonical_rows(spark, tmp_path):
    from graphloom.sources.rows import canonical

    g = GraphSession(spark)
    g.query("CREATE (:A {k: 1, name: 'x'})-[:T {w: 2}]->(:A {k: 2})")
    a, r = g.query("MATCH (a:A)-[r]->() RETURN a, r").first()
    assert rows(g, "MATCH (b:A) WHERE b <> $a RETURN b.k, $a.name, $r.w, type($r)", a=a, r=r) == [(2, "x", 2, "T")]
    copy = g.store.backup(str(tmp_path / "copy"))
    assert rows(GraphSession(spark, copy), "MATCH (a:A)-[r:T]->(b) RETURN a.k, r.w, b.k") == [(1, 2, 2)]
    got = canonical(g.query("MATCH (a:A) RETURN a.k AS k, {z: 1, b: null} AS m, a.name AS n ORDER BY k")).collect()
    assert [r["row"] for r in got] == ['{"k":1,"m":{"b":null,"z":1},"n":"x"}', '{"k":2,"m":{"b":null,"z":1},"n":null}']
