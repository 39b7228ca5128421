"""Syntax tree of a query, and its text form."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, Iterator


class CypherSyntaxError(ValueError):
    """The text is no query, or breaks a rule of scope; carries line and column."""

    def __init__(self, message: str, at: tuple[int, int] | None = None):
        super().__init__(f"{at[0]}:{at[1]}: {message}" if at else message)
        self.at = at


Pos = tuple[int, int]


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str
    at: Pos | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Slice(Expr):
    of: Expr
    low: Expr | None
    high: Expr | None


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    result: Expr | None


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    whens: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False
    at: Pos | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class HasLabels(Expr):
    of: Expr
    labels: tuple[str, ...]


@dataclass(frozen=True)
class NodePattern:
    var: str | None
    labels: tuple[str, ...] = ()
    props: MapOf | None = None
    at: Pos | None = field(default=None, compare=False)


@dataclass(frozen=True)
class RelPattern:
    var: str | None
    types: tuple[str, ...] = ()
    direction: str = "both"  # out, in, both
    variable: bool = False
    low: int = 1
    high: int | None = None
    props: MapOf | None = None
    at: Pos | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Part:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...]
    path: str | None = None
    shortest: str | None = None  # one, all
    at: Pos | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None

    @property
    def name(self) -> str:
        return self.alias if self.alias is not None else show(self.expr)


@dataclass(frozen=True)
class Projection:
    items: tuple[Item, ...]
    star: bool = False
    distinct: bool = False
    order: tuple[tuple[Expr, bool], ...] = ()  # (key, descending)
    skip: Expr | None = None
    limit: Expr | None = None


@dataclass(frozen=True)
class Clause:
    pass


@dataclass(frozen=True)
class Match(Clause):
    parts: tuple[Part, ...]
    where: Expr | None = None
    optional: bool = False


@dataclass(frozen=True)
class With(Clause):
    projection: Projection
    where: Expr | None = None


@dataclass(frozen=True)
class Return(Clause):
    projection: Projection


@dataclass(frozen=True)
class Unwind(Clause):
    expr: Expr
    var: str


@dataclass(frozen=True)
class Create(Clause):
    parts: tuple[Part, ...]


@dataclass(frozen=True)
class SetItem:
    kind: str  # prop, labels, replace, merge
    target: Expr
    key: str | None = None
    value: Expr | None = None
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Merge(Clause):
    part: Part
    on_create: tuple[SetItem, ...] = ()
    on_match: tuple[SetItem, ...] = ()


@dataclass(frozen=True)
class Set(Clause):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Remove(Clause):
    items: tuple[SetItem, ...]


@dataclass(frozen=True)
class Delete(Clause):
    exprs: tuple[Expr, ...]
    detach: bool = False


@dataclass(frozen=True)
class Schema(Clause):
    """Index and constraint commands."""

    action: str  # create index, drop index, show indexes, create constraint, drop constraint, show constraints
    name: str | None = None
    label: str | None = None
    key: str | None = None
    entity: str = "NODE"
    lenient: bool = False  # IF EXISTS / IF NOT EXISTS


WRITES = (Create, Merge, Set, Remove, Delete)


@dataclass(frozen=True)
class Query:
    arms: tuple[tuple[Clause, ...], ...]
    all_flags: tuple[bool, ...] = ()
    stream: bool = False

    @property
    def writes(self) -> bool:
        return any(isinstance(c, WRITES) or isinstance(c, Schema) and not c.action.startswith("show") for a in self.arms for c in a)


def show(e: Expr | None) -> str:
    """The text of an expression, as it names an unaliased column."""
    match e:
        case None:
            return ""
        case Lit(None):
            return "null"
        case Lit(bool() as b):
            return "true" if b else "false"
        case Lit(str() as s):
            return f"'{s}'"
        case Lit(v):
            return repr(v) if not isinstance(v, float) else f"{v:g}"
        case Param(n):
            return f"${n}"
        case Var(n):
            return n
        case Prop(of, key):
            return f"{show(of)}.{key}"
        case Index(of, at):
            return f"{show(of)}[{show(at)}]"
        case Slice(of, low, high):
            return f"{show(of)}[{show(low)}..{show(high)}]"
        case ListOf(items):
            return "[" + ", ".join(map(show, items)) + "]"
        case MapOf(items):
            return "{" + ", ".join(f"{k}: {show(v)}" for k, v in sorted(items)) + "}"
        case Comprehension(v, s, w, r):
            return f"[{v} IN {show(s)}" + (f" WHERE {show(w)}" if w else "") + (f" | {show(r)}" if r else "") + "]"
        case Quantifier(k, v, s, w):
            return f"{k}({v} IN {show(s)} WHERE {show(w)})"
        case Case(o, whens, d):
            return "CASE" + (f" {show(o)}" if o else "") + "".join(f" WHEN {show(a)} THEN {show(b)}" for a, b in whens) + (f" ELSE {show(d)}" if d else "") + " END"
        case Call(n, args, distinct, star):
            return f"{n}(" + ("*" if star else ("DISTINCT " if distinct else "") + ", ".join(map(show, args))) + ")"
        case Binary(op, a, b):
            return f"{show(a)} {op} {show(b)}"
        case Unary("-", of):
            return f"-{show(of)}"
        case Unary("NOT", of):
            return f"NOT {show(of)}"
        case Unary(op, of):
            return f"{show(of)} {op}"
        case HasLabels(of, labels):
            return show(of) + "".join(f":{x}" for x in labels)
    raise TypeError(e)


def parts_of(x: Any) -> Iterator[Any]:
    """x and every node of the tree below it."""
    yield x
    if is_dataclass(x):
        for f in fields(x):
            yield from parts_of(getattr(x, f.name))
    elif isinstance(x, tuple):
        for y in x:
            yield from parts_of(y)


#: Aggregates of the language.
AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")


def is_aggregate(e: Any) -> bool:
    return isinstance(e, Call) and e.name.lower() in AGGREGATES


def has_aggregate(e: Any) -> bool:
    return any(is_aggregate(x) for x in parts_of(e))
