"""Rules of scope: what a query may say, and the columns it returns."""

from __future__ import annotations

from dataclasses import dataclass

from . import syntax as S
from .syntax import CypherSyntaxError


@dataclass(frozen=True)
class Analysis:
    columns: tuple[str, ...]
    params: frozenset[str]


def _expr(e, scope: dict[str, str], aggregates: bool = False, inside: bool = False) -> None:
    match e:
        case None:
            return
        case S.Var(name, at):
            if name not in scope:
                raise CypherSyntaxError(f"variable {name} is not defined", at)
        case S.Comprehension() | S.Quantifier():
            _expr(e.source, scope, aggregates, inside)
            inner = scope | {e.var: "value"}
            _expr(e.where, inner)
            if isinstance(e, S.Comprehension):
                _expr(e.result, inner)
        case S.Call():
            if S.is_aggregate(e):
                if inside:
                    raise CypherSyntaxError(f"aggregate {e.name} inside an aggregate", e.at)
                if not aggregates:
                    raise CypherSyntaxError(f"aggregate {e.name} is only for WITH and RETURN", e.at)
                if e.star and e.name.lower() != "count":
                    raise CypherSyntaxError(f"{e.name}(*) is not an aggregate", e.at)
                if not e.star and len(e.args) != 1:
                    raise CypherSyntaxError(f"{e.name} takes one argument", e.at)
                for a in e.args:
                    _expr(a, scope, True, True)
            else:
                if e.distinct or e.star:
                    raise CypherSyntaxError(f"{e.name} is no aggregate", e.at)
                for a in e.args:
                    _expr(a, scope, aggregates, inside)
        case S.MapOf(items):
            for _, v in items:
                _expr(v, scope, aggregates, inside)
        case S.Case(operand, whens, default):
            for x in (operand, *(y for w in whens for y in w), default):
                _expr(x, scope, aggregates, inside)
        case S.Expr():
            for f in vars(e).values():
                for x in f if isinstance(f, tuple) else (f,):
                    if isinstance(x, S.Expr):
                        _expr(x, scope, aggregates, inside)


def _bind(scope: dict[str, str], name: str | None, kind: str, at) -> None:
    if name is None:
        return
    if name in scope:
        if scope[name] != kind and scope[name] not in ("value", "any"):
            raise CypherSyntaxError(f"{name} is a {scope[name]}, not a {kind}", at)
        if kind in ("relationship", "path"):
            raise CypherSyntaxError(f"variable {name} is already defined", at)
        return
    scope[name] = kind


def _parts(parts, scope: dict[str, str], clause: str) -> None:
    outer = dict(scope)
    if clause == "match":  # a pattern's properties may read any variable of the same MATCH
        seen = {**outer, **{x.var: "any" for p in parts for x in (*p.nodes, *p.rels) if x.var}}
    for p in parts:
        if p.shortest:
            if clause != "match":
                raise CypherSyntaxError("a shortest path is only for MATCH", p.at)
            if len(p.rels) != 1 or not p.rels[0].variable:
                raise CypherSyntaxError("a shortest path has exactly one variable-length relationship", p.at)
            if p.rels[0].low not in (0, 1) or p.rels[0].props:
                raise CypherSyntaxError("a shortest path starts at 0 or 1 and takes no properties", p.at)
            if any(n.var is None or n.labels or n.props for n in p.nodes):
                raise CypherSyntaxError("the ends of a shortest path are plain variables", p.at)
        elif p.path:
            raise CypherSyntaxError("a path variable is only for shortest paths", p.at)
        for n in p.nodes:
            _expr(n.props, seen if clause == "match" else scope)
            _bind(scope, n.var, "node", n.at)
        for r in p.rels:
            _expr(r.props, seen if clause == "match" else scope)
            if clause != "match":
                if r.variable:
                    raise CypherSyntaxError("a relationship that is created has no length", r.at)
                if len(r.types) != 1:
                    raise CypherSyntaxError("a relationship that is created has exactly one type", r.at)
                if r.direction == "both":
                    raise CypherSyntaxError("a relationship that is created has a direction", r.at)
            _bind(scope, r.var, "list" if r.variable else "relationship", r.at)
        _bind(scope, p.path, "path", p.at)
    if clause == "match":
        bound = set(outer) | {n.var for p in parts if not p.shortest for n in p.nodes}
        for p in parts:
            for n in p.nodes if p.shortest else ():
                if n.var not in bound:
                    raise CypherSyntaxError(f"the end {n.var} of a shortest path must be matched before it", p.at)


def _projection(p: S.Projection, scope: dict[str, str], named: bool) -> dict[str, str]:
    out: dict[str, str] = {}
    if p.star:
        if not scope:
            raise CypherSyntaxError("* needs variables in scope")
        out |= scope
    for i in p.items:
        _expr(i.expr, scope, True)
        if named and i.alias is None and not isinstance(i.expr, S.Var):
            raise CypherSyntaxError(f"{i.name} in WITH needs an alias")
        if i.name in out:
            raise CypherSyntaxError(f"column {i.name} is there twice")
        out[i.name] = scope[i.expr.name] if isinstance(i.expr, S.Var) else "any" if not S.has_aggregate(i.expr) else "value"
    grouped = p.distinct or any(S.has_aggregate(i.expr) for i in p.items)
    shown = {i.expr for i in p.items}
    for key, _ in p.order:
        if key in shown:
            continue
        if grouped:
            bad = [x for x in S.parts_of(key) if isinstance(x, S.Var) and x.name not in out]
            if bad and not _covered(key, shown):
                raise CypherSyntaxError(f"after DISTINCT or an aggregate, ORDER BY sees only what is returned, not {S.show(key)}", bad[0].at)
            if S.has_aggregate(key) and not _covered(key, shown):
                raise CypherSyntaxError(f"ORDER BY {S.show(key)} is not returned")
            if not bad:
                _expr(key, out, True)
        else:
            _expr(key, scope | out, False)
    for e in (p.skip, p.limit):
        if e is not None and any(isinstance(x, S.Var) for x in S.parts_of(e)):
            raise CypherSyntaxError("SKIP and LIMIT take no variables")
    return out


def _covered(e, shown: set) -> bool:
    """Whether e is made of returned expressions and constants."""
    if e in shown:
        return True
    if isinstance(e, S.Var) or S.is_aggregate(e):
        return False
    return all(_covered(x, shown) for f in (vars(e).values() if hasattr(e, "__dict__") else ()) for x in (f if isinstance(f, tuple) else (f,)) if isinstance(x, S.Expr))


def _arm(clauses, first_scope: dict[str, str]) -> tuple[str, ...]:
    scope = dict(first_scope)
    columns: tuple[str, ...] = ()
    for n, c in enumerate(clauses):
        last = n == len(clauses) - 1
        match c:
            case S.Schema(action):
                if len(clauses) > 1:
                    raise CypherSyntaxError("a schema command stands alone")
                columns = {"show indexes": ("name", "label", "property", "entity"), "show constraints": ("name", "label", "property", "type")}.get(action, ())
            case S.Match(parts, where):
                _parts(parts, scope, "match")
                _expr(where, scope)
                paths = {p.path for p in parts if p.shortest} | {p.rels[0].var for p in parts if p.shortest}
                for x in S.parts_of(where):
                    if isinstance(x, S.Var) and x.name in paths - {None}:
                        raise CypherSyntaxError(f"WHERE of the same MATCH cannot see the shortest path {x.name}", x.at)
            case S.With(p, where):
                scope = _projection(p, scope, True)
                _expr(where, scope)
            case S.Return(p):
                if not last:
                    raise CypherSyntaxError("RETURN is the last clause")
                columns = tuple(_projection(p, scope, False))
            case S.Unwind(e, var):
                _expr(e, scope)
                if var in scope:
                    raise CypherSyntaxError(f"variable {var} is already defined")
                scope[var] = "any"
            case S.Create(parts):
                _parts(parts, scope, "create")
            case S.Merge(part, made, met):
                if len(part.rels) > 1:
                    raise CypherSyntaxError("MERGE takes one relationship at most", part.at)
                if part.rels and part.nodes[0].var not in scope:
                    raise CypherSyntaxError("MERGE of a relationship starts at a bound node", part.at)
                _parts((part,), scope, "merge")
                for i in (*made, *met):
                    _expr(i.target, scope)
                    _expr(i.value, scope)
            case S.Set(items) | S.Remove(items):
                for i in items:
                    _expr(i.target, scope)
                    _expr(i.value, scope)
            case S.Delete(exprs):
                for e in exprs:
                    _expr(e, scope)
    end = clauses[-1]
    if not isinstance(end, (S.Return, S.Schema, *S.WRITES)):
        raise CypherSyntaxError("a query ends in RETURN or a write")
    return columns


def analyse(query: S.Query) -> Analysis:
    columns = [_arm(a, {}) for a in query.arms]
    if len(query.arms) > 1:
        if any(not isinstance(a[-1], S.Return) for a in query.arms):
            raise CypherSyntaxError("each arm of UNION ends in RETURN")
        if len(set(columns)) > 1:
            raise CypherSyntaxError("the arms of UNION return the same columns")
    if query.stream:
        if query.writes:
            raise CypherSyntaxError("a STREAM query only reads")
        if any(isinstance(c, S.Schema) for a in query.arms for c in a):
            raise CypherSyntaxError("a schema command is no STREAM query")
    return Analysis(columns[0], frozenset(x.name for x in S.parts_of(query) if isinstance(x, S.Param)))
