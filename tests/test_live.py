"""Live queries: what is kept up to date equals what is computed from scratch."""

import random

import pytest

from graphloom import cli
from graphloom.cypher import parse
from graphloom.errors import ResultLimitError, StreamQueryError
from graphloom.runtime import Folder
from graphloom.session import GraphSession
from graphloom.streaming.footprint import anchored, footprint


@pytest.mark.parametrize(
    "q, labels, types, keys",
    [
        ("MATCH (n:A) RETURN n.x", {"A"}, set(), {"x"}),
        ("MATCH (n) RETURN n.x", None, set(), {"x"}),
        ("MATCH (n:A)-[:T]->(m:B {k: 1}) RETURN count(*)", {"A", "B"}, {"T"}, {"k"}),
        ("MATCH (n:A)-->(m:B) RETURN id(n)", {"A", "B"}, None, set()),
        ("MATCH (n:A) RETURN n", {"A"}, set(), None),
        ("MATCH (n:A) RETURN labels(n), count(n)", {"A"}, set(), set()),
        ("MATCH (n:A) WHERE n:C RETURN n.x", {"A", "C"}, set(), {"x"}),
        ("MATCH (n:A) RETURN [x IN n.l | x]", {"A"}, set(), None),
        ("MATCH (n:A) WITH n AS m RETURN m.x", {"A"}, set(), None),
        ("MATCH (n:A) RETURN keys(n)", {"A"}, set(), None),
    ],
)
def test_footprint(q, labels, types, keys):
    f = footprint(parse(q))
    assert (f.labels, f.types, f.keys) == (labels, types, keys)


@pytest.mark.parametrize("q, yes", [("MATCH (a)-[r]->(b) WHERE a.x > 1 RETURN a.x, b.y", True), ("MATCH (a) RETURN count(*)", False), ("MATCH (a) RETURN a.x ORDER BY a.x", False), ("MATCH (a)-[*]->(b) RETURN a.x", False), ("MATCH (a) RETURN DISTINCT a.x", False), ("OPTIONAL MATCH (a) RETURN a.x", False), ("MATCH (a) WITH a RETURN a.x", False)])
def test_anchored(q, yes):
    assert anchored(parse(q)) is yes


def bag(df):
    return sorted(map(repr, df.collect()))


def test_random_changes(spark):
    rng = random.Random(3)
    g = GraphSession(spark)
    g.query("UNWIND range(0, 5) AS i CREATE (:A {k: i, v: i % 3})")
    queries = ["MATCH (a:A)-[r:T]->(b:A) WHERE a.v > 0 RETURN a.k AS a, b.v AS b", "MATCH (a:A) RETURN a.v AS v, count(*) AS n"]
    live = [g.subscribe(q) for q in queries]
    kept = [bag(x.poll().added) for x in live]
    changes = [
        lambda: f"MATCH (a:A {{k: {rng.randrange(6)}}}), (b:A {{k: {rng.randrange(6)}}}) CREATE (a)-[:T]->(b)",
        lambda: f"MATCH (a:A {{k: {rng.randrange(6)}}}) SET a.v = {rng.randrange(3)}",
        lambda: f"MATCH (a:A {{k: {rng.randrange(6)}}}) DETACH DELETE a",
        lambda: f"CREATE (:A {{k: {rng.randrange(6)}, v: 1}})",
    ]
    for step in range(5):
        g.query(changes[step % len(changes)]())
        for i, x in enumerate(live):
            if (c := x.poll()) is not None:
                for r in bag(c.removed):
                    kept[i].remove(r)
                kept[i] = sorted(kept[i] + bag(c.added))
            assert kept[i] == bag(g.query(queries[i])), (step, queries[i])


def test_a_poll_at_any_moment_of_a_commit_misses_nothing(spark, monkeypatch):
    """A version is seen with its changes or not at all: polls just before and after the manifest is there."""
    g = GraphSession(spark)
    g.query("CREATE (:A {k: 1})")
    live = g.subscribe("MATCH (a:A) RETURN a.k AS k")
    live.poll()
    got = []
    real = Folder.create

    def create(self, name, text):
        got.append(live.poll())
        done = real(self, name, text)
        got.append(live.poll())
        return done

    monkeypatch.setattr(Folder, "create", create)
    g.query("CREATE (:A {k: 2})")
    monkeypatch.undo()
    assert got[0] is None and [tuple(r) for r in got[1].added.collect()] == [(2,)] and live.poll() is None
    g.query("MATCH (a:A {k: 1}) SET a.other = 5")
    assert live.poll() is None and live.mode == "skipped"


@pytest.mark.parametrize("q", ["MATCH (a:A)-[:T]->(b:A) RETURN a.k AS a, b.k AS b", "MATCH (a:A) RETURN count(*) AS n"])
def test_a_checkpoint_is_gone_on_from(spark, tmp_path, q):
    g = GraphSession(spark, str(tmp_path / "store"))
    g.query("CREATE (:A {k: 1})-[:T]->(:A {k: 2})")
    where = str(tmp_path / "live")
    first = g.subscribe(q, checkpoint=where)
    first.poll()
    g.query("CREATE (:A {k: 3})-[:T]->(:A {k: 4})")
    first.poll()
    first.close()
    with pytest.raises(StreamQueryError):
        first.poll()
    before = bag(g.query(q))
    g.query("MATCH (a:A {k: 3}) DETACH DELETE a")
    c = GraphSession(spark, str(tmp_path / "store")).subscribe(q, checkpoint=where).poll()
    left = [*before]
    for r in bag(c.removed):
        left.remove(r)
    assert not c.initial and sorted(left + bag(c.added)) == bag(g.query(q))
    with pytest.raises(StreamQueryError):
        g.subscribe("MATCH (a:A) RETURN a.k", checkpoint=where)


def test_many_batches_are_merged_and_limits_end_a_query(spark, monkeypatch):
    from graphloom.streaming import live as module

    monkeypatch.setattr(module, "MOST_PARTS", 2)
    monkeypatch.setattr(module, "MOST_DIRTY", 3)
    g = GraphSession(spark)
    g.query("UNWIND range(0, 5) AS i CREATE (:A {k: i})")
    live = g.subscribe("MATCH (a:A) RETURN a.k AS k", max_rows=7)
    live.poll()
    for i in range(3):
        g.query(f"MATCH (a:A {{k: {i}}}) SET a.k = {i + 10}")
        c = live.poll()
        assert (bag(c.added), bag(c.removed), live.mode) == ([f"Row(k={i + 10})"], [f"Row(k={i})"], "anchored")
        assert len(live._parts) <= 2
    g.query("MATCH (a:A) SET a.k = a.k + 100")
    assert live.poll().added.count() == 6 and live.mode == "full"  # more changed nodes than the limit
    g.query("CREATE (:A {k: 7}), (:A {k: 8})")
    with pytest.raises(ResultLimitError):
        live.poll()
    assert isinstance(live.error, ResultLimitError)


def test_background_and_rejections(spark, monkeypatch):
    g = GraphSession(spark)
    g.query("CREATE (:P {n: 1})")
    got = []
    live = g.subscribe("MATCH (p:P) RETURN p.n AS n")
    stream = live.start(lambda c: got.append((sorted(r[0] for r in c.added.collect()), c.initial)), 0.2)
    g.query("CREATE (:P {n: 2})")
    stream.processAllAvailable()
    ends = []
    live._on_end = ends.append
    live.close()
    assert ends == [None]
    assert got == [([1], True), ([2], False)]
    for q in ("CREATE (:X)", "SHOW INDEXES"):
        with pytest.raises(StreamQueryError):
            g.subscribe(q)
    with pytest.raises(StreamQueryError):
        g.query("STREAM MATCH (p:P) RETURN p.n")
    assert cli.table(spark.range(5), 3).splitlines()[-1] == "(the first 3 rows)" and cli.table(spark.range(3), 3).splitlines()[-1] == "(3 rows)"
    monkeypatch.setenv("EDITOR", "sed -i s/old/new/")
    shown = []
    cli.loop(g, ["RETURN 'old' AS x;\n", ":edit\n"], shown.append)
    assert ["old" in shown[0], "new" in shown[1]] == [True, True]
    assert "PushedFilters" in g.explain("MATCH (p:P) WHERE p.n = 1 RETURN p.n AS n", plan=True)
    out = []
    cli.loop(g, ["MATCH (p:P)\n", "RETURN p.n AS n ORDER BY n;\n", ":explain MATCH (p) RETURN p\n", "BAD;\n", "STREAM MATCH (p:P) RETURN p.n;\n", ":quit\n"], out.append)
    assert out[0].startswith("n\n1\n2") and out[1].startswith("Project") and "CypherSyntaxError" in out[2] and out[3:] == ["+ (1,)", "+ (2,)"]
