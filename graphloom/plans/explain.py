"""The operators of a query, as text."""

from __future__ import annotations

import itertools

from ..cypher import syntax as S


class _Plan:
    """A tree of lines: an operator's inputs are below it, indented."""

    def __init__(self, line: str, *inputs: "_Plan | None"):
        self.line, self.inputs = line, [x for x in inputs if x is not None]

    def text(self, depth: int = 0) -> str:
        return "\n".join(["  " * depth + self.line, *(x.text(depth + 1) for x in self.inputs)])


def _conjuncts(e: S.Expr | None) -> list[S.Expr]:
    if e is None:
        return []
    if isinstance(e, S.Binary) and e.op == "AND":
        return _conjuncts(e.left) + _conjuncts(e.right)
    return [e]


_FLIP = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


class _Explainer:
    def __init__(self, indexes: set[tuple[str, str, str]]):
        self.indexes, self.n, self.r = indexes, itertools.count(), itertools.count()

    def query(self, q: S.Query) -> _Plan:
        arms = [self.arm(a) for a in q.arms]
        if len(arms) == 1:
            return arms[0]
        return _Plan("UnionAll" if all(q.all_flags) else "Union", *arms)

    def arm(self, clauses) -> _Plan:
        plan, bound = None, set()
        for c in clauses:
            plan = self.clause(c, plan, bound)
        return plan

    def clause(self, c: S.Clause, plan: _Plan | None, bound: set[str]) -> _Plan:
        match c:
            case S.Match(parts, where, False):
                return self.match(parts, where, plan, bound)
            case S.Match(parts, where, True):
                before = set(bound)
                inner = self.match(parts, where, _Plan("Argument"), bound)
                return _Plan(f"OuterApply(new=[{', '.join(sorted(v for v in bound - before if not v.startswith('_')))}])", plan, inner)
            case S.With(p, where):
                return self.projection(p, where, plan, bound)
            case S.Return(p):
                return self.projection(p, None, plan, bound)
            case S.Unwind(e, var):
                bound.add(var)
                return _Plan(f"Unwind({S.show(e)} AS {var})", plan)
            case S.Create(parts):
                bound.update(x.var for p in parts for x in (*p.nodes, *p.rels) if x.var)
                return _Plan("Create(" + ", ".join(map(self.shown, parts)) + ")", plan)
            case S.Merge(part):
                bound.update(x.var for x in (*part.nodes, *part.rels) if x.var)
                return _Plan(f"Merge({self.shown(part)})", plan)
            case S.Set(items) | S.Remove(items):
                name = type(c).__name__
                return _Plan(f"{name}(" + ", ".join(self.item(i) for i in items) + ")", plan)
            case S.Delete(exprs, detach):
                return _Plan(("DetachDelete(" if detach else "Delete(") + ", ".join(map(S.show, exprs)) + ")", plan)
            case S.Schema(action, name, label, key):
                return _Plan({"create index": f"CreateIndex(:{label}.{key})", "drop index": f"DropIndex({name})", "show indexes": "ShowIndexes", "create constraint": f"CreateConstraint(:{label}.{key} UNIQUE)", "drop constraint": f"DropConstraint({name})", "show constraints": "ShowConstraints"}[action])
        raise TypeError(c)

    @staticmethod
    def item(i: S.SetItem) -> str:
        t = S.show(i.target)
        match i.kind:
            case "labels":
                return t + "".join(f":{x}" for x in i.labels)
            case "prop":
                return f"{t}.{i.key}" + (f" = {S.show(i.value)}" if i.value is not None else "")
        return f"{t} {'=' if i.kind == 'replace' else '+='} {S.show(i.value)}"

    def shown(self, p: S.Part) -> str:
        out = ""
        for i, n in enumerate(p.nodes):
            if i:
                r = p.rels[i - 1]
                body = f"[{r.var or ''}{':' + '|'.join(r.types) if r.types else ''}]"
                out += f"{'<' if r.direction == 'in' else ''}-{body}-{'>' if r.direction == 'out' else ''}"
            out += f"({n.var or ''}{''.join(':' + x for x in n.labels)}{' ' + S.show(n.props) if n.props else ''})"
        return out

    def match(self, parts, where, plan, bound) -> _Plan:
        tests = _conjuncts(where)
        extra: list[S.Expr] = []
        for p in sorted(parts, key=lambda p: p.shortest is not None):
            names = [n.var or f"_n{next(self.n)}" for n in p.nodes]
            if p.shortest:
                r = p.rels[0]
                fn = "ShortestPath" if p.shortest == "one" else "AllShortestPaths"
                plan = _Plan(f"{fn}({names[0]}){self.arrow(r, r.var or f'_r{next(self.r)}')}({names[1]})" + (f" AS {p.path}" if p.path else ""), plan)
                bound.update(x for x in (p.path, r.var) if x)
                continue
            start = next((i for i, n in enumerate(names) if n in bound), None)
            if start is None:
                seeks = [self.seek(n, v, tests, bound) for n, v in zip(p.nodes, names)]
                start = max(range(len(seeks)), key=lambda i: (seeks[i][0], -i))
                leaf, outside = _Plan(seeks[start][1]), seeks[start][2]
                bound.add(names[start])
                if seeks[start][0] < 3 and (by := self.rel_seek(p, names, tests)) is not None:
                    i, leaf = by
                    start = i
                    bound.update((names[i], names[i + 1], p.rels[i].var or ""))
                    done = i
                else:
                    done = None
                plan = leaf if plan is None or plan.line == "Argument" and not outside else _Plan("Apply" if outside else "CartesianProduct", plan, leaf)
            else:
                done = None
            for i in [*range(start, len(p.rels)), *range(start - 1, -1, -1)]:
                if i == done:
                    continue
                a, b = (i, i + 1) if i >= start else (i + 1, i)
                r = p.rels[i]
                var = r.var or f"_r{next(self.r)}"
                shown = r if i >= start else S.RelPattern(r.var, r.types, {"out": "in", "in": "out", "both": "both"}[r.direction], r.variable, r.low, r.high)
                plan = _Plan(f"Expand({names[a]}){self.arrow(shown, var)}({names[b]})", plan)
                bound.update((names[b], var))
                extra += [S.Binary("=", S.Prop(S.Var(var), k), e) for k, e in (r.props.items if r.props else ())]
                n = p.nodes[b]
                extra += [S.HasLabels(S.Var(names[b]), n.labels)] if n.labels else []
            for n, v in zip(p.nodes, names):
                extra += [S.Binary("=", S.Prop(S.Var(v), k), e) for k, e in (n.props.items if n.props else ())]
        rest = extra + tests
        if rest:
            plan = _Plan("Filter(" + " AND ".join(map(S.show, rest)) + ")", plan)
        return plan

    def seek(self, n: S.NodePattern, var: str, tests, bound) -> tuple[int, str, bool]:
        """How good an anchor the node is, its scan, and whether that reads bound variables."""
        equal = [(k, e) for k, e in (n.props.items if n.props else ())]
        ranges = []
        for t in tests:
            if not isinstance(t, S.Binary):
                continue
            for a, b, op in ((t.left, t.right, t.op), (t.right, t.left, _FLIP.get(t.op, ""))):
                if isinstance(a, S.Prop) and a.of == S.Var(var) and not any(isinstance(x, S.Var) and x.name not in bound for x in S.parts_of(b)):
                    if op == "=":
                        equal.append((a.key, b))
                    elif op in ("<", "<=", ">", ">=") or op == "STARTS WITH" and a is t.left:
                        ranges.append((a.key, op, b))
        for label in n.labels:
            for k, e in equal:
                if (label, k, "NODE") in self.indexes:
                    return 4, f"NodeByProperty({var}:{label} {{{k} = {S.show(e)}}})", any(isinstance(x, S.Var) for x in S.parts_of(e))
            for k, _, _ in ranges:
                if (label, k, "NODE") in self.indexes:
                    own = [r for r in ranges if r[0] == k]
                    return 3, f"NodeByPropertyRange({var}:{label} {{{', '.join(f'{k} {op} {S.show(e)}' for k, op, e in own)}}})", any(isinstance(x, S.Var) for r in own for x in S.parts_of(r[2]))
        if n.labels:
            return 2, f"NodeByLabelScan({var}:{n.labels[0]})", False
        return 1, f"AllNodesScan({var})", False

    def rel_seek(self, p: S.Part, names, tests) -> tuple[int, _Plan] | None:
        """The first relationship of the part that an index finds by an equal property."""
        for i, r in enumerate(p.rels):
            if r.variable or len(r.types) != 1:
                continue
            equal = [(k, e) for k, e in (r.props.items if r.props else ())]
            equal += [(t.left.key, t.right) for t in tests if isinstance(t, S.Binary) and t.op == "=" and isinstance(t.left, S.Prop) and r.var and t.left.of == S.Var(r.var) and isinstance(t.right, (S.Lit, S.Param))]
            for k, e in equal:
                if (r.types[0], k, "RELATIONSHIP") in self.indexes:
                    return i, _Plan(f"RelByProperty(({names[i]}){self.arrow(r, r.var or '_r')}({names[i + 1]}) {{{k} = {S.show(e)}}})")
        return None

    @staticmethod
    def arrow(r: S.RelPattern, var: str) -> str:
        hops = ""
        if r.variable:
            hops = "*" + (str(r.low) if r.low == r.high else f"{'' if r.low == 1 else r.low}" + (f"..{'' if r.high is None else r.high}" if r.high is not None or r.low != 1 else ""))
        body = f"[{var}{':' + '|'.join(r.types) if r.types else ''}{hops}]"
        return f"{'<' if r.direction == 'in' else ''}-{body}-{'>' if r.direction == 'out' else ''}"

    def projection(self, p: S.Projection, where, plan, bound) -> _Plan:
        items = list(p.items)
        if p.star:
            items = [S.Item(S.Var(v), v) for v in sorted(bound) if not v.startswith("_")] + items
        names = {i.name for i in items}
        grouped = any(S.has_aggregate(i.expr) for i in items)
        keys = ", ".join(S.show(k) + (" DESC" if d else "") for k, d in p.order)
        above = grouped or p.distinct or all(x.name in names for k, _ in p.order for x in S.parts_of(k) if isinstance(x, S.Var))
        if p.order and not above:
            plan = _Plan(f"Sort({keys})", plan)
        if grouped:
            by = [S.show(i.expr) for i in items if not S.has_aggregate(i.expr)]
            aggs = [f"{S.show(i.expr)} AS {i.name}" for i in items if S.has_aggregate(i.expr)]
            plan = _Plan(f"Aggregate(group=[{', '.join(by)}] aggs=[{', '.join(aggs)}])", plan)
        else:
            plan = _Plan(f"Project([{'DISTINCT ' if p.distinct else ''}{', '.join(f'{S.show(i.expr)} AS {i.name}' for i in items)}])", plan)
        if where is not None:
            plan = _Plan(f"Filter({S.show(where)})", plan)
        if p.order and above:
            plan = _Plan(f"Sort({keys})", plan)
        if p.skip is not None:
            plan = _Plan(f"Skip({S.show(p.skip)})", plan)
        if p.limit is not None:
            plan = _Plan(f"Limit({S.show(p.limit)})", plan)
        bound.clear()
        bound.update(i.name for i in items)
        return plan


def explain(q: S.Query, indexes: set[tuple[str, str, str]] = frozenset()) -> str:
    """A tree of operators, two blanks a level, the last one first; indexes: (label or type, key, entity)."""
    return _Explainer(set(indexes)).query(q).text()
