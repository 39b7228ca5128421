"""Lexer, parser and scope rules, without Spark."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.cypher import CypherSyntaxError, analyse, parse
from graphloom.cypher import syntax as S
from graphloom.plans.explain import explain


def expr(text: str) -> S.Expr:
    return parse(f"RETURN {text}").arms[0][0].projection.items[0].expr


@pytest.mark.parametrize(
    "text, shown",
    [
        ("1 + 2 * 3", "1 + 2 * 3"),
        ("a.b.c", "a.b.c"),
        ("NOT a AND b OR c", "NOT a AND b OR c"),
        ("x IN [1, 2]", "x IN [1, 2]"),
        ("[x IN l WHERE x > 1 | x.k]", "[x IN l WHERE x > 1 | x.k]"),
        ("l[1..]", "l[1..]"),
        ("l[..-1]", "l[..-1]"),
        ("count(DISTINCT n)", "count(DISTINCT n)"),
        ("count(*)", "count(*)"),
        ("{b: 1, a: 'x'}", "{a: 'x', b: 1}"),
        ("$p", "$p"),
        ("CASE x WHEN 1 THEN 'a' ELSE 'b' END", "CASE x WHEN 1 THEN 'a' ELSE 'b' END"),
        ("n:A:B", "n:A:B"),
        ("any(x IN l WHERE x = 1)", "any(x IN l WHERE x = 1)"),
    ],
)
def test_expressions_print_as_they_read(text, shown):
    assert S.show(expr(text)) == shown


def test_precedence():
    assert expr("1 + 2 * 3") == S.Binary("+", S.Lit(1), S.Binary("*", S.Lit(2), S.Lit(3)))
    assert expr("NOT a = b") == S.Unary("NOT", S.Binary("=", S.Var("a"), S.Var("b")))
    assert expr("-x.y") == S.Unary("-", S.Prop(S.Var("x"), "y"))
    assert expr("a OR b AND c") == S.Binary("OR", S.Var("a"), S.Binary("AND", S.Var("b"), S.Var("c")))


def test_numbers_and_strings():
    assert [expr(x) for x in ("1", "1.", ".5", "1e5", r"'a\n\'b'", '"q"')] == [S.Lit(1), S.Lit(1.0), S.Lit(0.5), S.Lit(1e5), S.Lit("a\n'b"), S.Lit("q")]
    assert expr("[1..3]" if False else "l[1..3]") == S.Slice(S.Var("l"), S.Lit(1), S.Lit(3))


@pytest.mark.parametrize("spelling, low, high", [("*", 1, None), ("*2", 2, 2), ("*2..", 2, None), ("*..3", 1, 3), ("*0..1", 0, 1)])
def test_variable_length(spelling, low, high):
    r = parse(f"MATCH (a)-[:T{spelling}]->(b) RETURN a").arms[0][0].parts[0].rels[0]
    assert (r.variable, r.low, r.high) == (True, low, high)


@pytest.mark.parametrize("text, direction, types", [("(a)-->(b)", "out", ()), ("(a)<--(b)", "in", ()), ("(a)--(b)", "both", ()), ("(a)-[:T|U]->(b)", "out", ("T", "U"))])
def test_directions(text, direction, types):
    r = parse(f"MATCH {text} RETURN a").arms[0][0].parts[0].rels[0]
    assert (r.direction, r.types) == (direction, types)


@pytest.mark.parametrize(
    "text, at",
    [
        ("MATCH (a RETURN a", (1, 10)),
        ("RETURN 'abc", (1, 8)),
        ("RETURN 99999999999999999999", (1, 8)),
        ("MATCH (a)<-[:T]->(b) RETURN a", (1, 10)),
        ("FOO", (1, 1)),
        ("MATCH (a)\nRETURN b", (2, 8)),
        ("MATCH (a) WHERE count(a) > 1 RETURN a", (1, 17)),
        ("RETURN count(count(1))", (1, 14)),
    ],
)
def test_errors_have_positions(text, at):
    with pytest.raises(CypherSyntaxError) as e:
        analyse(parse(text))
    assert e.value.at == at


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (a) WITH a.x RETURN 1",
        "MATCH (a)",
        "RETURN *",
        "MATCH (a) RETURN a MATCH (b) RETURN b",
        "MATCH (a) RETURN a.x AS x UNION MATCH (a) RETURN a.y AS y",
        "MATCH p = (a)-[:T]->(b) RETURN p",
        "MATCH p = shortestPath((a)-[:T*]->(b)) RETURN p",
        "MATCH (a), (b), p = shortestPath((a)-[:T*2..3]->(b)) RETURN p",
        "MATCH (a), (b), p = shortestPath((a)-[:T*]->(b)) WHERE length(p) > 1 RETURN p",
        "MATCH (a)-[r:T]->(b), (c)-[r:T]->(d) RETURN a",
        "CREATE (a)-[:T]-(b)",
        "CREATE (a)-[:T|U]->(b)",
        "MERGE (a)-[:T]->(b)",
        "MATCH (a) RETURN DISTINCT a.x AS x ORDER BY a.y",
        "MATCH (a) RETURN a LIMIT a.x",
        "STREAM CREATE (a)",
        "UNWIND [1] AS x UNWIND [2] AS x RETURN x",
        "MATCH (a)-[r:T*1..2 {k: 1}]->(b) RETURN a",
    ],
)
def test_rejected(text):
    with pytest.raises(CypherSyntaxError):
        analyse(parse(text))


def test_columns_and_params():
    a = analyse(parse("MATCH (n {k: $a}) RETURN n.x, n.y AS y, count(*) ORDER BY y LIMIT $b"))
    assert a.columns == ("n.x", "y", "count(*)") and a.params == {"a", "b"}


def test_explain():
    text = explain(parse("MATCH (a:P {uid: 1})-[r:K*..2]->(b) WHERE b.n > 'a' RETURN a.n AS n ORDER BY n LIMIT 2"), {("P", "uid", "NODE")})
    assert text.splitlines() == ["Limit(2)", "  Sort(n)", "    Project([a.n AS n])", "      Filter(a.uid = 1 AND b.n > 'a')", "        Expand(a)-[r:K*..2]->(b)", "          NodeByProperty(a:P {uid = 1})"]
    by = explain(parse("MATCH (a)-[r:T {k: 1}]->(b)-[:U]->(c) RETURN c.x AS x"), {("T", "k", "RELATIONSHIP")}).splitlines()
    assert by[-1].strip() == "RelByProperty((a)-[r:T]->(b) {k = 1})" and by[-2].strip() == "Expand(b)-[_r0:U]->(c)"
    assert explain(parse("MATCH (a)-[r:T]->(b) RETURN a.x AS x")).splitlines()[-1].strip() == "AllNodesScan(a)"
    assert explain(parse("MATCH (a) OPTIONAL MATCH (a)-[:T]->(b) RETURN a")).splitlines()[1].strip() == "OuterApply(new=[b])"
    assert explain(parse("RETURN 1 AS x UNION ALL RETURN 2 AS x")).startswith("UnionAll")


@given(st.text(max_size=40))
def test_any_text_parses_or_fails_cleanly(text):
    try:
        analyse(parse(text))
    except CypherSyntaxError:
        pass
