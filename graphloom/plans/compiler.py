"""Clauses to DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cypher import syntax as S
from ..functions import comparison
from ..functions.comparison import number_of, order_key
from ..operators.paths import expand_trails, shortest_paths
from ..operators.scan import ends_imply, own_end, rel_tables, scan_nodes, scan_rels, scan_rels_with_end, towards
from ..sources.graph import Graph
from ..types import ANY, FLOAT, INT, NULL, CypherTypeError, Type, Value, as_list, common, convert, list_of, spark_type
from .expressions import Expressions
from .order import bindings, join_order
from .scope import Binding, Node, Plain, Rel, fresh


@dataclass(frozen=True)
class Rows:
    """The rows so far: None for the one empty row; order: a column that numbers sorted rows."""

    df: DataFrame | None
    scope: dict[str, Binding]
    order: str | None = None


class Compiler:
    def __init__(self, spark: SparkSession, graph: Graph, params: Mapping[str, object] | None = None, strict: bool = False):
        self.spark, self.graph = spark, graph
        self.x = Expressions(params or {}, graph, strict)
        self.labels: dict[str, tuple[str, ...]] = {}  # of nodes whose labels not every mention has

    # Queries.

    def query(self, q: S.Query) -> DataFrame:
        arms = [self.arm(a) for a in q.arms]
        if len(arms) == 1:
            return self.returned(arms[0])
        names = list(arms[0].scope)
        types = [reduce(lambda p, r: common(p, r, "UNION columns"), (a.scope[n].value().type for a in arms)) for n in names]
        frames = []
        for a in arms:
            df = a.df if a.df is not None else self.unit()
            frames.append(df.select(*[convert(a.scope[n].value(), t).col.alias(n) for n, t in zip(names, types)]))
        out = reduce(DataFrame.union, frames)
        return out if all(q.all_flags) else out.distinct()

    def returned(self, rows: Rows) -> DataFrame:
        df = rows.df if rows.df is not None else self.unit()
        return df.select(*[b.value().col.alias(n) for n, b in rows.scope.items()])

    def unit(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(0).alias(fresh("unit")))

    def arm(self, clauses: tuple[S.Clause, ...], rows: Rows | None = None) -> Rows:
        self.uses = self._uses(clauses)
        rows = rows or Rows(None, {})
        for c in clauses:
            rows = self.clause(c, rows)
        return rows

    def clause(self, c: S.Clause, rows: Rows) -> Rows:
        match c:
            case S.Match(parts, where, False):
                return self.match(parts, where, rows)
            case S.Match(parts, where, True):
                return self.optional(parts, where, rows)
            case S.With(p, where):
                return self.project(p, where, rows)
            case S.Return(p):
                return self.project(p, None, rows)
            case S.Unwind(e, var):
                return self.unwind(e, var, rows)
        raise CypherTypeError(f"{type(c).__name__.upper()} needs a store")

    def _uses(self, clauses) -> Counter:
        """How often each variable is read; patterns count where they test more than the identity of a node that is bound before."""
        uses: Counter = Counter()
        for c in clauses:
            for x in S.parts_of(c):
                if isinstance(x, S.Var):
                    uses[x.name] += 1
                if isinstance(x, S.Projection) and x.star:
                    uses["*"] += 1
        # A path whose nodes are not asked for is kept as ids.
        lean = Counter(x.args[0].name for c in clauses for x in S.parts_of(c) if isinstance(x, S.Call) and x.name.lower() in ("length", "relationships") and len(x.args) == 1 and isinstance(x.args[0], S.Var))
        paths = {x.path for c in clauses for x in S.parts_of(c) if isinstance(x, S.Part) and x.shortest and x.path}
        self.whole = {n for n in paths if uses[n] > lean[n] or uses["*"]}
        mentions: Counter = Counter()
        for c in clauses:
            for x in S.parts_of(c):
                if isinstance(x, S.NodePattern) and x.var:
                    if mentions[x.var] and (x.labels or x.props):
                        uses[x.var] += 1
                    mentions[x.var] += 1
        return uses

    def used(self, var: str | None) -> bool:
        return var is not None and (bool(self.uses["*"]) and not var.startswith("#") or self.uses[var] > 0)

    # Patterns.

    def match(self, parts: tuple[S.Part, ...], where: S.Expr | None, rows: Rows) -> Rows:
        hidden = dict(rows.scope)
        later, self.later = getattr(self, "later", []), []
        better = join_order(self.graph, parts, lambda n: isinstance(hidden.get(n), Node))
        self.labels = {n.var: n.labels for p in better or () for n in p.nodes if n.labels}
        for p in sorted(better or parts, key=lambda p: p.shortest is not None):
            rows = self.shortest(p, rows) if p.shortest else self.part(p, rows, hidden)
        if better:
            rows = replace(rows, scope={n: rows.scope[n] for n in bindings(parts, hidden) if n in rows.scope} | {n: b for n, b in rows.scope.items() if not n.startswith("#")})
        for b, k, e in self.later:
            rows = replace(rows, df=rows.df.where(comparison.equal(b.prop(k), self.x.value(e, rows.scope)).col))
        self.later = later
        if where is not None:
            rows = self.with_ends(rows, (where,))
            df = rows.df if rows.df is not None else self.unit()
            rows = replace(rows, df=df.where(self.x.condition(self._ends(where), rows.scope)))
        return rows

    def part(self, p: S.Part, rows: Rows, outer: Mapping[str, Binding]) -> Rows:
        names = [n.var or fresh("#n") for n in p.nodes]
        scope = dict(rows.scope)
        at = next((i for i, n in enumerate(names) if isinstance(scope.get(n), Node)), None)
        df = rows.df
        if at is None:
            at = 0
            first, n = p.nodes[0], names[0]
            if n in scope:
                raise CypherTypeError(f"{n} is no node")
            r = p.rels[0] if p.rels else None
            if r is not None and not r.variable and names[0] != names[1]:
                tables = self._leaving(towards(rel_tables(self.graph, r.types), r.direction, p.nodes[1].labels), r.direction, first.labels)
                lean = not self.used(first.var) and not first.props and ends_imply(tables, r.direction, "from", first.labels)
                own = own_end(tables, r.direction, "from") if not lean else None
                if lean or own is not None and set(first.labels) <= set(own.labels):
                    if lean:
                        edges, rel, a, b, target = self._edges(tables, r, p.nodes[1])
                        binding = Node(a, None)
                    else:
                        edges, rel, a, b, binding = scan_rels_with_end(tables[0], r.direction, "from")
                        target = None
                    df = edges if df is None else df.crossJoin(edges)
                    scope[n] = binding
                    rows = self._props(replace(rows, df=df, scope=scope), binding, first.props, outer)
                    rows = self._arrive(rows, tables, r, rel, b, p.nodes[1], names[1], outer, target)
                    return self._rest(p, names, rows, 1, 0, outer)
            nodes, binding = scan_nodes(self.spark, self.graph, first.labels)
            df = nodes if df is None else df.crossJoin(nodes)
            scope[n] = binding
            rows = replace(rows, df=df, scope=scope)
            rows = self._props(rows, binding, first.props, outer)
        else:
            rows = self._check(rows, scope[names[at]], p.nodes[at], outer)
        return self._rest(p, names, rows, at, at, outer)

    def _rest(self, p: S.Part, names: list[str], rows: Rows, right: int, left: int, outer) -> Rows:
        for i in range(right, len(p.rels)):
            rows = self._expand(rows, names[i], p.rels[i], p.nodes[i + 1], names[i + 1], outer)
        for i in range(left - 1, -1, -1):
            r = p.rels[i]
            back = replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction])
            rows = self._expand(rows, names[i + 1], back, p.nodes[i], names[i], outer)
        for n, own in zip(names, p.nodes):
            if not own.var:
                rows.scope.pop(n, None)
        return rows

    def _props(self, rows: Rows, b: Node | Rel, props: S.MapOf | None, outer) -> Rows:
        """Inline properties; those that read variables of the same MATCH are tested when all are bound."""
        if props is None:
            return rows
        tests = []
        for k, e in props.items:
            if any(isinstance(x, S.Var) and x.name not in outer and x.name in self.uses for x in S.parts_of(e)):
                self.later.append((b, k, e))
            else:
                tests.append(comparison.equal(b.prop(k), self.x.value(e, outer)).col)
        return replace(rows, df=rows.df.where(reduce(lambda p, q: p & q, tests))) if tests else rows

    def _check(self, rows: Rows, b: Node, n: S.NodePattern, outer) -> Rows:
        """Labels and properties of a pattern on a node that is bound already."""
        if n.labels:
            has = self.x._has_labels(S.Var(n.var), n.labels, rows.scope, None).col if n.var in rows.scope else F.lit(True)
            rows = replace(rows, df=rows.df.where(has))
        return self._props(rows, b, n.props, outer)

    def _edges(self, tables, r: S.RelPattern, to: S.NodePattern):
        """Relationships, with the node that they lead to where that is in the same rows and is read."""
        own = own_end(tables, r.direction, "to")
        if own is not None and (self.used(to.var) or to.props) and set(to.labels) <= set(own.labels):
            return scan_rels_with_end(tables[0], r.direction, "to")
        return *scan_rels(self.spark, tables, r.types, r.direction), None

    @staticmethod
    def _leaving(tables, direction: str, labels: tuple[str, ...]):
        """The tables that can start at a node that has these labels, among others."""
        return towards(tables, {"out": "in", "in": "out", "both": "both"}[direction], labels)

    @staticmethod
    def _known(b: Node) -> frozenset[str] | None:
        """All labels of a node, where its table tells."""
        return frozenset(b.labels) if isinstance(b.labels, tuple) else None

    def _prune(self, b: Node, tables, direction: str):
        """Without tables that cannot start at a node of known labels."""
        if not isinstance(b.labels, tuple) or direction == "both":
            return tables
        side = "src_labels" if direction == "out" else "dst_labels"
        return [t for t in tables if getattr(t, side) is None or getattr(t, side) == frozenset(b.labels)]

    def _expand(self, rows: Rows, start: str, r: S.RelPattern, to: S.NodePattern, name: str, outer) -> Rows:
        b = rows.scope[start]
        tables = rel_tables(self.graph, r.types)
        if r.variable:
            df, end, rels, item = expand_trails(self.spark, tables, r.types, r.direction, rows.df, b.id, self._known(b), r.low, r.high, self.used(r.var))
            scope = dict(rows.scope)
            if rels:
                scope[r.var] = Plain(rels, list_of(item))
            return self._to(replace(rows, df=df, scope=scope), tables, r, end, to, name, outer)
        tables = towards(self._prune(b, tables, r.direction), r.direction, to.labels or self.labels.get(name, ()))
        tables = self._leaving(tables, r.direction, self.labels.get(start, ()))
        new = to if name not in rows.scope else S.NodePattern(None)
        edges, rel, a, e, target = self._edges(tables, r, new)
        rows = replace(rows, df=rows.df.join(edges, F.col(b.id) == F.col(a)))
        return self._arrive(rows, tables, r, rel, e, to, name, outer, target)

    def _arrive(self, rows: Rows, tables, r: S.RelPattern, rel: Rel, end: str, to: S.NodePattern, name: str, outer, target: Node | None = None) -> Rows:
        scope = dict(rows.scope)
        if r.var:
            scope[r.var] = rel
        rows = self._props(replace(rows, scope=scope), rel, r.props, outer)
        return self._to(rows, tables, r, end, to, name, outer, target)

    def _to(self, rows: Rows, tables, r: S.RelPattern, end: str, to: S.NodePattern, name: str, outer, target: Node | None = None) -> Rows:
        b = rows.scope.get(name)
        if isinstance(b, Node):
            rows = replace(rows, df=rows.df.where(F.col(end) == F.col(b.id)))
            return self._check(rows, b, to, outer)
        if b is not None:
            raise CypherTypeError(f"{name} is no node")
        scope = dict(rows.scope)
        if target is not None:
            scope[name] = target
            return self._props(replace(rows, scope=scope), target, to.props, outer)
        if not self.used(to.var) and not to.props and r.low > 0 and ends_imply(tables, r.direction, "to", to.labels):
            scope[name] = Node(end, None)
            return replace(rows, scope=scope)
        nodes, binding = scan_nodes(self.spark, self.graph, to.labels)
        scope[name] = binding
        rows = replace(rows, df=rows.df.join(nodes, F.col(end) == F.col(binding.id)), scope=scope)
        return self._props(rows, binding, to.props, outer)

    def shortest(self, p: S.Part, rows: Rows) -> Rows:
        a, b = (rows.scope.get(n.var) for n in p.nodes)
        if not isinstance(a, Node) or not isinstance(b, Node):
            raise CypherTypeError("the ends of a shortest path are nodes")
        r = p.rels[0]
        scope = dict(rows.scope)
        tables = rel_tables(self.graph, r.types)
        if r.high == 0 and r.low == 0:
            tables = []
        whole = p.path in self.whole
        df, path, node, rel = shortest_paths(self.spark, self.graph, tables, r.types, r.direction, rows.df, a.id, self._known(a), b.id, self._known(b), r.low, r.high, p.shortest == "all", whole)
        nodes = node.value().type if whole else Type("map", fields=(("id", INT),))
        if p.path:
            scope[p.path] = Plain(path, Type("path", fields=(("nodes", nodes), ("rels", rel.value().type))))
        if r.var:
            name = fresh("rels")
            df = df.withColumn(name, F.col(path)["rels"])
            scope[r.var] = Plain(name, list_of(rel.value().type))
        return replace(rows, df=df, scope=scope)

    def optional(self, parts: tuple[S.Part, ...], where: S.Expr | None, rows: Rows) -> Rows:
        """Rows without a match keep nulls.  A match is computed once for each combination of what it reads from the rows, and joined back."""
        df = rows.df if rows.df is not None else self.unit()
        rows = replace(rows, df=df)
        if (direct := self._direct(parts, where, rows)) is not None:
            return direct
        read = {x.name for y in (*parts, where) for x in S.parts_of(y) if isinstance(x, S.Var)} | {n.var for p in parts for n in p.nodes}
        given = {n: b for n, b in rows.scope.items() if n in read}
        ids = [b.id if isinstance(b, (Node, Rel)) else b.columns()[0] for b in given.values()]
        rest = [c for b in given.values() for c in b.columns() if c not in ids]
        if ids:
            keys = df.groupBy(*ids).agg(*[F.first(c).alias(c) for c in rest]) if rest else df.select(*ids).distinct()
            to = {c: fresh("k") for c in (*ids, *rest)}
            start = Rows(keys.select(*[F.col(c).alias(to[c]) for c in (*ids, *rest)]), {n: b.renamed(to) for n, b in given.items()})
        else:
            start = Rows(None, {})
        found = self.match(parts, where, start)
        new = {n: b for n, b in found.scope.items() if n not in rows.scope}
        inner = found.df.select(*([to[c] for c in ids] if ids else []), *dict.fromkeys(c for b in new.values() for c in b.columns()))
        on = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(to[c])) for c in ids], F.lit(True))
        out = df.join(inner, on, "left")
        return replace(rows, df=out, scope=rows.scope | {n: self._loose(b) for n, b in new.items()})

    @staticmethod
    def _loose(b: Binding) -> Binding:
        return b

    def _direct(self, parts, where, rows: Rows) -> Rows | None:
        """One hop from a bound node to a new one: a left join with the conditions in it."""
        if len(parts) != 1 or len(parts[0].rels) != 1 or parts[0].shortest or parts[0].rels[0].variable:
            return None
        p = parts[0]
        nodes, r = list(p.nodes), p.rels[0]
        if nodes[0].var not in rows.scope:
            nodes.reverse()
            r = replace(r, direction={"out": "in", "in": "out", "both": "both"}[r.direction])
        a, b = nodes
        start = rows.scope.get(a.var)
        if not isinstance(start, Node) or a.labels or a.props or b.var in rows.scope or r.var in rows.scope or a.var == b.var:
            return None
        tables = towards(self._prune(start, rel_tables(self.graph, r.types), r.direction), r.direction, b.labels)
        edges, rel, f, e, node = self._edges(tables, r, b)
        inner = Rows(edges, {})
        inner = self._arrive(inner, tables, replace(r, props=None), rel, e, replace(b, props=None), b.var or "#to", rows.scope, node)
        target = inner.scope[b.var or "#to"]
        scope = rows.scope | {n: x for n, x in inner.scope.items() if not n.startswith("#")}
        on = F.col(start.id) == F.col(f)
        for of, props in ((rel, r.props), (target, b.props)):
            for k, v in props.items if props else ():
                if any(isinstance(x, S.Var) and x.name not in rows.scope for x in S.parts_of(v)):
                    return None
                if of is target and not isinstance(of.labels, (str, tuple)) and not of.props:
                    return None
                on = on & comparison.equal(of.prop(k), self.x.value(v, rows.scope)).col
        if where is not None:
            if any(isinstance(x, S.Call) and x.name.lower() in ("startnode", "endnode") for x in S.parts_of(where)):
                return None
            on = on & self.x.condition(where, scope)
        return replace(rows, df=rows.df.join(inner.df, on, "left"), scope=scope)

    # startNode and endNode.

    def with_ends(self, rows: Rows, exprs) -> Rows:
        """rows with the nodes that startNode and endNode in the expressions ask for."""
        for e in exprs:
            for x in S.parts_of(e):
                if isinstance(x, S.Call) and x.name.lower() in ("startnode", "endnode") and len(x.args) == 1 and isinstance(x.args[0], S.Var):
                    rel, name = rows.scope.get(x.args[0].name), self._end_name(x)
                    if isinstance(rel, Rel) and name not in rows.scope:
                        end, among = (rel.src, rel.src_labels) if x.name.lower() == "startnode" else (rel.dst, rel.dst_labels)
                        nodes, b = scan_nodes(self.spark, self.graph, (), among)
                        rows = replace(rows, df=rows.df.join(nodes, F.col(end) == F.col(b.id), "left"), scope={**rows.scope, name: b})
        return rows

    @staticmethod
    def _end_name(x: S.Call) -> str:
        return f"#{x.name.lower()}:{x.args[0].name}"

    def _ends(self, e):
        """e with startNode(r) and endNode(r) as variables."""
        if isinstance(e, S.Call) and e.name.lower() in ("startnode", "endnode") and len(e.args) == 1 and isinstance(e.args[0], S.Var):
            return S.Var(self._end_name(e))
        if isinstance(e, tuple):
            return tuple(self._ends(x) for x in e)
        if isinstance(e, S.Expr):
            return type(e)(**{k: self._ends(v) if isinstance(v, (S.Expr, tuple)) and k != "at" or isinstance(v, S.Expr) else v for k, v in vars(e).items()})
        return e

    # Projections.

    def unwind(self, e: S.Expr, var: str, rows: Rows) -> Rows:
        if isinstance(e, S.Param) and isinstance(given := self.x.params.get(e.name), DataFrame):
            from ..types import type_of

            t = Type("map", fields=tuple((f.name, type_of(f.dataType)) for f in given.schema.fields))
            name = fresh("row")
            one = given.select(F.struct(*[convert(Value(F.col(f"`{f}`"), x), x).col.cast(spark_type(x)).alias(f) for f, x in t.fields]).alias(name))
            return replace(rows, df=one if rows.df is None else rows.df.crossJoin(one), scope={**rows.scope, var: Plain(name, t)}, order=None)
        df = rows.df if rows.df is not None else self.unit()
        v = self.x.value(e, rows.scope)
        if v.type == NULL:
            return replace(rows, df=df.where(F.lit(False)).withColumn(name := fresh("u"), F.lit(None).cast("void")), scope={**rows.scope, var: Plain(name, NULL)})
        v = as_list(v, "UNWIND")
        if v.type.kind != "list":
            raise CypherTypeError(f"UNWIND takes a list, not a {v.type.kind}")
        name = fresh("u")
        df = df.withColumn(name, F.explode(v.col))
        return replace(rows, df=df, scope={**rows.scope, var: Plain(name, v.type.item)})

    def project(self, p: S.Projection, where: S.Expr | None, rows: Rows) -> Rows:
        items = list(p.items)
        if p.star:
            items = [S.Item(S.Var(n), n) for n in rows.scope if not n.startswith("#")] + items
        rows = self.with_ends(rows, [i.expr for i in items] + [k for k, _ in p.order])
        named = [(i.name, self._ends(i.expr)) for i in items]
        order = [(self._ends(k), d) for k, d in p.order]
        if any(S.has_aggregate(e) for _, e in named):
            out, hidden = self.aggregate(named, rows), {}
        else:
            df = rows.df if rows.df is not None else self.unit()
            scope: dict[str, Binding] = {}
            added = {}
            for name, e in named:
                if isinstance(e, S.Var) and e.name in rows.scope and not hasattr(rows.scope[e.name], "of"):
                    scope[name] = rows.scope[e.name]
                    continue
                v = self.x.value(e, rows.scope)
                added[c := fresh("c")] = v.col
                scope[name] = Plain(c, v.type)
            out = Rows(df.withColumns(added) if added else df, scope, rows.order)
            hidden = {} if p.distinct else rows.scope
        if p.distinct:
            keys = [c for b in out.scope.values() for c in ([b.id] if isinstance(b, (Node, Rel)) else b.columns())]
            out = replace(out, df=out.df.dropDuplicates(keys) if keys else out.df.limit(1), order=None)
        if where is not None:
            out = replace(out, df=out.df.where(self.x.condition(where, out.scope)))
        if order:
            given = {e: out.scope[n].value() for n, e in named if not isinstance(e, S.Var)}
            # Only a column that was projected stands for its expression; names that were rebound hide the old ones.
            keys = []
            for k, down in order:
                v = self.x.value(k, {**hidden, **out.scope}, given)
                col = order_key(v)
                keys.append(col.desc_nulls_first() if down else col.asc_nulls_last())
            df = out.df.orderBy(*keys)
            if p.skip is not None or p.limit is not None:
                df = self._page(df, p)
            out = replace(out, df=df, order=None)
            out = replace(out, df=out.df.withColumn(o := fresh("o"), F.monotonically_increasing_id()), order=o)
        elif p.skip is not None or p.limit is not None:
            out = replace(out, df=self._page(out.df, p))
        return replace(out, scope=dict(out.scope))

    def _page(self, df: DataFrame, p: S.Projection) -> DataFrame:
        if p.skip is not None and (n := self.x.constant(p.skip)) > 0:
            df = df.offset(n)
        if p.limit is not None:
            df = df.limit(max(0, self.x.constant(p.limit)))
        return df

    def aggregate(self, named: list[tuple[str, S.Expr]], rows: Rows) -> Rows:
        df = rows.df if rows.df is not None else self.unit()
        scope = rows.scope
        keys = [(n, e) for n, e in named if not S.has_aggregate(e)]
        calls = list(dict.fromkeys(x for _, e in named for x in S.parts_of(e) if S.is_aggregate(x)))
        added, by, firsts = {}, [], []
        out: dict[str, Binding] = {}
        given: dict[S.Expr, Value] = {}
        for n, e in keys:
            b = scope.get(e.name) if isinstance(e, S.Var) else None
            if isinstance(b, (Node, Rel)):
                by.append(b.id)
                firsts += [c for c in b.columns() if c != b.id]
                if isinstance(b, Rel):
                    by.append(b.type)
                    firsts = [c for c in firsts if c != b.type]
                out[n] = b
                continue
            v = self.x.value(e, scope)
            added[c := fresh("g")] = v.col
            by.append(c)
            out[n] = Plain(c, v.type)
            given[e] = Value(F.col(c), v.type)
        results, kinds = [], {}
        for call in calls:
            col, t = self._aggregate(call, scope, rows.order)
            results.append(col.alias(c := fresh("a")))
            kinds[call] = (c, t)
        df = df.withColumns(added) if added else df
        aggs = [*results, *[F.first(c).alias(c) for c in dict.fromkeys(firsts)]]
        df = df.groupBy(*dict.fromkeys(by)).agg(*aggs) if by else df.agg(*aggs)
        for call, (c, t) in kinds.items():
            given[call] = Value(F.col(c), t)
        final = {}
        ordered: dict[str, Binding] = {}
        for n, e in named:
            if n in out:
                ordered[n] = out[n]
            elif e in kinds:
                ordered[n] = Plain(*kinds[e])
            else:
                v = self.x.value(e, {m: b for m, b in out.items()}, given)
                final[c := fresh("c")] = v.col
                ordered[n] = Plain(c, v.type)
        return Rows(df.withColumns(final) if final else df, ordered)

    def _aggregate(self, call: S.Call, scope, order: str | None) -> tuple[Column, Type]:
        name = call.name.lower()
        if call.star:
            return F.count(F.lit(1)), INT
        (arg,) = call.args
        b = scope.get(arg.name) if isinstance(arg, S.Var) else None
        if name == "count" and isinstance(b, (Node, Rel)):
            ids = [F.col(b.id)] if isinstance(b, Node) else [F.col(b.type), F.col(b.id)]
            return (F.count_distinct(*ids) if call.distinct else F.count(F.col(b.id))), INT
        v = self.x.value(self._ends(arg), scope)
        if name == "count":
            if v.type == NULL:
                return F.count(F.lit(None)), INT
            return (F.count_distinct(v.col) if call.distinct else F.count(v.col)), INT
        if name == "collect":
            t = list_of(v.type)
            if v.type == NULL:
                none = F.array().cast(spark_type(t))
                return F.coalesce(F.first(none), none), t
            if order is None:
                return (F.collect_set(v.col) if call.distinct else F.collect_list(v.col)), t
            got = F.transform(F.array_sort(F.collect_list(F.when(v.col.isNotNull(), F.struct(F.col(order).alias("o"), v.col.alias("v"))))), lambda x: x["v"])
            return (F.array_distinct(got) if call.distinct else got), t
        if name in ("min", "max"):
            if v.type.entity or v.type.kind in ("list", "map", "path"):
                raise CypherTypeError(f"{name} takes plain values")
            if v.type == ANY:
                pair = F.when(v.col.isNotNull(), F.struct(order_key(v).alias("k"), v.col.alias("v")))
                return (F.min(pair) if name == "min" else F.max(pair))["v"], ANY
            return (F.min(v.col) if name == "min" else F.max(v.col)), v.type
        if v.type == ANY:
            number = number_of(v.col)
            v = Value(F.when(v.col.isNotNull() & number.isNull(), F.raise_error(F.lit(f"{name} takes numbers")).cast("double")).otherwise(number), FLOAT)
        if not v.type.number and v.type != NULL:
            raise CypherTypeError(f"{name} takes numbers")
        if v.type == NULL:
            return (F.coalesce(F.first(F.lit(0)), F.lit(0)).cast("long"), INT) if name == "sum" else (F.first(F.lit(None).cast("double")), FLOAT)
        if name == "sum":
            total = F.sum_distinct(v.col) if call.distinct else F.sum(v.col)
            return F.coalesce(total, F.lit(0).cast(spark_type(v.type))), v.type
        mean = F.sum_distinct(v.col.cast("double")) / F.nullif(F.count_distinct(v.col), F.lit(0)) if call.distinct else F.avg(v.col)
        return mean.cast("double"), FLOAT


