"""Properties and lists that hold values of several kinds."""

import math

import pytest

from graphloom.errors import ConstraintViolation
from graphloom.session import GraphSession
from graphloom.sources.graph import Graph
from graphloom.types import plain

N, T, F = None, True, False
L = "[1, 'a', 2.5, true, null]"
TABLE = [
    (f"{L}[1]", "a"), (f"{L}[0] = 1", T), (f"{L}[1] = 'a'", T), (f"{L}[1] = 1", F), (f"{L}[4] = 1", N), (f"'a' IN {L}", T), (f"'b' IN {L}", N), (f"2.5 IN {L}", T), (f"1 IN {L}", T),
    ("[1, 'a'] = [1, 'a']", T), ("[1, 'a'] = [1.0, 'b']", F), (f"{L}[0] < 2", T), (f"{L}[1] < 2", N), (f"{L}[1] < 'b'", T), (f"{L}[1] STARTS WITH 'a'", T), (f"{L}[0] STARTS WITH 'a'", N),
    ("['x', 4][1] + 1", 5.0), ("['x', 4][1] / 2", 2.0), ("['x', 1][0] + 'y'", "xy"), ("-['x', 4][1]", -4), ("['x', 4][2] + 1", N), (f"{L}[3] AND true", T), (f"NOT {L}[3]", F),
    ("toInteger(['7', 1][0])", 7), ("toString(['7', true][1])", "true"), ("toUpper(['a', 1][0])", "A"), ("abs([-2, 'a'][0])", 2), ("size(['abc', 1][0])", 3), ("coalesce(null, 'a', 1)", "a"),
    ("CASE WHEN true THEN 1 ELSE 'a' END", 1), (f"[x IN {L} WHERE x > 1]", [2.5]), (f"size({L} + ['z'])", 6), ("[[1], ['a']][1][0]", "a"),
]


def test_table(spark):
    row = GraphSession(spark, Graph()).query("RETURN " + ", ".join(f"{e} AS c{j}" for j, (e, _) in enumerate(TABLE))).first()
    assert [(e, plain(got)) for (e, _), got in zip(TABLE, row)] == [(e, want) for e, want in TABLE]


M = "[1, [2, 'b'], {k: 3, l: [4, null]}, 'z']"
NESTED = [
    ("[1, [2]]", [1, [2]]), (M, [1, [2, "b"], {"k": 3, "l": [4, N]}, "z"]), (f"{M}[1]", [2, "b"]), (f"{M}[1][1]", "b"), (f"{M}[2].k", 3), (f"{M}[2].l[0]", 4), (f"{M}[2]['l'][1]", N), (f"{M}[2].none", N),
    (f"size({M}[1])", 2), (f"head({M}[1])", 2), (f"{M}[1][0] + 1", 3.0), (f"{M}[1] = [2, 'b']", T), (f"{M}[1] = [2.0, 'b']", T), (f"{M}[1] = [2, 'c']", F), (f"{M}[1] = 2", F), ("[1, [2, null]][1] = [2, null]", N), ("[1, [2, null]][1] = [3, null]", F),
    (f"[2, 'b'] IN {M}", T), (f"'b' IN {M}[1]", T), (f"[x IN {M}[1] WHERE x = 'b']", ["b"]), (f"any(x IN {M}[1] WHERE x > 1)", T), (f"{M}[1][0..1]", [2]), ("CASE WHEN true THEN 1 ELSE [1] END", 1), ("CASE WHEN false THEN 1 ELSE [1.5, 'q\\'s \"'] END", [1.5, "q's \""]),
    ("coalesce(null, [1, {a: true}], 5)", [1, {"a": T}]), ("[1, [2]][1] < 3", N), ("['a,1.0]', ['b']][0]", "a,1.0]"), ("size([[1, 'x'], 5][0])", 2), ("[[], 0][0]", []), ("[{}, 0][0] IS NULL", F),
]


def test_nested(spark):
    deep = lambda x: [deep(y) for y in plain(x)] if isinstance(plain(x), list) else plain(x)
    for i in range(0, len(NESTED), 6):  # a query of all would be too long for compiled code
        part = NESTED[i : i + 6]
        row = GraphSession(spark, Graph()).query("RETURN " + ", ".join(f"{e} AS c{j}" for j, (e, _) in enumerate(part))).first()
        assert [(e, deep(got)) for (e, _), got in zip(part, row)] == part


def test_properties_of_any_shape(spark):
    g = GraphSession(spark)
    g.query("CREATE (:B {id: 1, v: [1]}), (:B {id: 2, v: 5}), (:B {id: 3, v: {a: [1, 'x']}}), (:B {id: 4, v: ['x', 2]}), (:B {id: 5, v: [1]}), (:B {id: 6})")
    values = {r["id"]: plain(r["v"]) for r in g.query("MATCH (b:B) RETURN b.id AS id, b.v AS v").collect()}
    assert values == {1: [1], 2: 5, 3: {"a": [1, "x"]}, 4: ["x", 2], 5: [1], 6: None}
    ids = lambda where: sorted(r[0] for r in g.query(f"MATCH (b:B) WHERE {where} RETURN b.id AS id").collect())
    assert ids("b.v = [1]") == [1, 5] and ids("b.v = 5") == [2] and ids("b.v > 4") == [2] and ids("b.v IN [[1], 5]") == [1, 2, 5] and ids("b.v <> [1]") == [2, 3, 4]
    assert ids("b.id <> 2 AND b.id <> 3 AND size(b.v) = 2") == [4]
    assert g.query("MATCH (b:B) RETURN count(DISTINCT b.v) AS n").first()["n"] == 4
    assert [r[0] for r in g.query("MATCH (b:B) RETURN b.id AS id ORDER BY b.v, id").collect()] == [3, 4, 1, 5, 2, 6]
    got = g.query("MATCH (b:B {id: 4}) UNWIND b.v AS x RETURN x").collect()
    assert [plain(r[0]) for r in got] == ["x", 2]
    g.query("MATCH (b:B {id: 6}) SET b.v = $v", {"v": [1, [2, "deep"]]})
    assert plain(g.query("MATCH (b:B {id: 6}) RETURN b.v[1][1] AS v").first()["v"]) == "deep"
    union = g.query("RETURN 1 AS x UNION RETURN [1] AS x UNION RETURN {a: 1} AS x")
    assert sorted((plain(r[0]) for r in union.collect()), key=str) == [1, [1], {"a": 1}]


@pytest.mark.parametrize("e", ["-['a', 1][x]", "['a', 1][x] * 2", "NOT ['a', 1][x]", "abs(['a', 1][x])"])
def test_values_without_meaning(spark, e):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        GraphSession(spark, Graph()).query(f"UNWIND [0] AS x RETURN {e} AS v").collect()


def test_stored(spark):
    g = GraphSession(spark)
    g.query("CREATE (:P {id: 1, x: 5}), (:P {id: 2, x: 7})")
    live = g.subscribe("MATCH (p:P) RETURN p.id AS id, p.x AS x")
    live.poll()
    g.query("CREATE (:P {id: 3, x: 'five'}), (:P {id: 4, x: true}), (:P {id: 5, x: 5.5}), (:P {id: 6})")
    c = live.poll()
    values = lambda df: sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)
    assert values(c.removed) == [] and values(c.added) == [(3, "five"), (4, True), (5, 5.5), (6, None)]
    ids = lambda where: sorted(r[0] for r in g.query(f"MATCH (p:P) WHERE {where} RETURN p.id AS id").collect())
    assert ids("p.x > 5") == [2, 5] and ids("p.x >= 'a'") == [3] and ids("p.x = 5") == [1] and ids("p.x = 5.0") == [1] and ids("p.x") == [4] and ids("p.x STARTS WITH 'f'") == [3] and ids("p.x IS NULL") == [6]
    assert ids("p.x <> 5") == [2, 3, 4, 5] and ids("p.x IN [7, 'five']") == [2, 3]
    assert [r[0] for r in g.query("MATCH (p:P) RETURN p.id AS id ORDER BY p.x, id").collect()] == [3, 4, 1, 5, 2, 6]
    r = g.query("MATCH (p:P) RETURN min(p.x) AS a, max(p.x) AS b, count(DISTINCT p.x) AS n").first()
    assert (plain(r["a"]), plain(r["b"]), r["n"]) == ("five", 7, 5)
    assert g.query("MATCH (p:P) WHERE p.x > 0 RETURN sum(p.x) AS s").first()["s"] == 17.5
    g.query("MERGE (p:P {x: 'five'}) ON MATCH SET p.y = $v", {"v": r["a"]})
    assert [tuple(x) for x in g.query("MATCH (p:P) WHERE p.y IS NOT NULL RETURN p.id AS id, p.y AS y").collect()] == [(3, "five")]
    g.query("CREATE CONSTRAINT FOR (p:P) REQUIRE p.x IS UNIQUE")
    with pytest.raises(ConstraintViolation):
        g.query("CREATE (:P {id: 9, x: 5.0})")
    g.query("CREATE (:P {id: 9, x: '5'}), (:P {x: sqrt(-1)}), (:P {x: sqrt(-1)})")
    union = g.query("MATCH (p:P {id: 9}) RETURN p.x AS v UNION RETURN 1 AS v UNION RETURN 'a' AS v")
    assert sorted((plain(x[0]) for x in union.collect()), key=str) == [1, "5", "a"]
    assert sum(math.isnan(plain(x[0])) for x in g.query("MATCH (p:P) WHERE p.id IS NULL RETURN p.x AS x").collect()) == 2
