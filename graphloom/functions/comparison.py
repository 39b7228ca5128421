"""Equality, order, membership and logic with three truth values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ANY, BOOL, FLOAT, NESTED, SCALARS, STR, CypherTypeError, Type, Value, as_list, common, convert, elements, holds_list, null


def _unknown(a: Value, b: Value, otherwise: Column) -> Column:
    return F.when(a.col.isNull() | b.col.isNull(), F.lit(None).cast("boolean")).otherwise(otherwise)


def _may_be_nan(a: Value, b: Value) -> bool:
    """Spark takes NaN as equal to itself and above all numbers; a constant other than NaN on one side rules that out for equality."""
    return all(not v.known and v.type == FLOAT or v.known and v.const != v.const for v in (a, b))


def _mixed(x: Type, y: Type) -> bool:
    return ANY in (x, y) and {x.kind, y.kind} <= {"any", "list", "map", *(t.kind for t in SCALARS.values())}


def number_of(c: Column) -> Column:
    """The number that a value of any holds, as a double."""
    return F.coalesce(c["as_int"].cast("double"), c["as_float"])


def _nested_equal(p: Column, q: Column) -> Column:
    """Equality of lists element by element, and of maps, and lists in lists, as they are written."""

    def one(x: Column, y: Column) -> Column:
        return _by_value(Value(x, ANY), Value(y, ANY), equal, F.lit(False), lambda a, b: a[NESTED] == b[NESTED]).col

    a, b = elements(p), elements(q)
    lists = F.when(F.size(a) != F.size(b), F.lit(False)).otherwise(F.forall(F.zip_with(a, b, one), lambda z: z))
    return F.when(holds_list(p) & holds_list(q), lists).otherwise(p[NESTED] == q[NESTED])


def _by_value(a: Value, b: Value, test: Callable[[Value, Value], Value], otherwise: Column, nested: Callable[[Column, Column], Column] | None = None) -> Value:
    """test on what two values of any hold, if it is of one kind, and nested on lists and maps; integers meet as integers."""
    p, q = convert(a, ANY).col, convert(b, ANY).col
    kinds = [("as_int", SCALARS["as_int"]), ("as_str", STR), ("as_bool", BOOL)]
    out = F.when(p.isNull() | q.isNull(), F.lit(None).cast("boolean"))
    for k, t in kinds:
        out = out.when(p[k].isNotNull() & q[k].isNotNull(), test(Value(p[k], t), Value(q[k], t)).col)
    if nested is not None:
        out = out.when(p[NESTED].isNotNull() & q[NESTED].isNotNull(), nested(p, q))
    m, n = number_of(p), number_of(q)
    return Value(out.when(m.isNotNull() & n.isNotNull(), test(Value(m, FLOAT), Value(n, FLOAT)).col).otherwise(otherwise), BOOL)


def order_key(v: Value) -> Column:
    """What values are sorted by: among those of any maps come first, then lists, strings, booleans, and numbers."""
    if v.type != ANY:
        return v.col["id"] if v.type.entity else v.col
    c = v.col
    rank = F.when(c["as_str"].isNotNull(), 0).when(c["as_bool"].isNotNull(), 1).when(holds_list(c), -1).when(c[NESTED].isNotNull(), -2).otherwise(2)
    return F.when(c.isNotNull(), F.struct(rank, c[NESTED], c["as_str"], c["as_bool"], number_of(c), c["as_int"]))


def same_key(v: Value) -> Column:
    """A key that equal values of any share; null for NaN."""
    c = v.col
    whole = (F.floor(c["as_float"]) == c["as_float"]) & (F.abs(c["as_float"]) < 2.0**63)
    i = F.coalesce(c["as_int"], F.when(whole, c["as_float"]).cast("long"))
    return F.when(c.isNotNull() & ~F.coalesce(F.isnan(c["as_float"]), F.lit(False)), F.struct(c["as_bool"], i, F.when(i.isNull(), c["as_float"]), c["as_str"], c[NESTED]))


def equal(a: Value, b: Value) -> Value:
    x, y = a.type, b.type
    if _mixed(x, y):
        return _by_value(a, b, equal, F.lit(False), _nested_equal)
    if "null" in (x.kind, y.kind):
        return null(BOOL)
    if x.number and y.number:
        if x == y == FLOAT and _may_be_nan(a, b):
            return Value((a.col == b.col) & ~F.isnan(a.col), BOOL)
        return Value(a.col == b.col, BOOL)
    if x.kind != y.kind:
        return Value(_unknown(a, b, F.lit(False)), BOOL)
    if x.kind in ("bool", "str", "time"):
        return Value(a.col == b.col, BOOL)
    if x.entity:
        return Value(a.col["id"] == b.col["id"] if x.kind == "node" else (a.col["id"] == b.col["id"]) & (a.col["type"] == b.col["type"]), BOOL)
    if x.kind == "list":
        if "null" in (x.item.kind, y.item.kind):
            same = F.when(F.size(a.col) == 0, F.lit(True)).otherwise(F.lit(None).cast("boolean"))
        else:
            same = F.forall(F.zip_with(a.col, b.col, lambda p, q: equal(Value(p, x.item), Value(q, y.item)).col), lambda z: z)
        return Value(_unknown(a, b, F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(same)), BOOL)
    if x.kind == "map":
        if {k for k, _ in x.fields} != {k for k, _ in y.fields}:
            return Value(_unknown(a, b, F.lit(False)), BOOL)
        each = [equal(Value(a.col[k], t), Value(b.col[k], y.field(k))).col for k, t in x.fields]
        return Value(_unknown(a, b, reduce(lambda p, q: p & q, each, F.lit(True))), BOOL)
    raise CypherTypeError(f"a {x.kind} has no equality")


def compare(op: str, a: Value, b: Value) -> Value:
    x, y = a.type, b.type
    if _mixed(x, y):
        return _by_value(a, b, lambda p, q: compare(op, p, q), F.lit(None).cast("boolean"))
    if not (x.number and y.number or x.kind == y.kind and x.kind in ("str", "bool", "time")):
        return null(BOOL)
    c = {"<": a.col < b.col, "<=": a.col <= b.col, ">": a.col > b.col, ">=": a.col >= b.col}[op]
    for v in (a, b):
        if v.type == FLOAT and (not v.known or v.const != v.const):
            c = c & ~F.isnan(v.col) if not v.known else F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    return Value(c, BOOL)


def member(v: Value, items: Value) -> Value:
    if items.type.kind == "null":
        return null(BOOL)
    items = as_list(items, "IN")
    if items.type.kind != "list":
        raise CypherTypeError(f"IN takes a list, not a {items.type.kind}")
    t = items.type.item
    if items.known and items.const is not None and not items.const:
        return Value(F.lit(False), BOOL)
    if items.known and items.const and None not in items.const and v.type.kind == t.kind and t.kind in ("int", "str", "bool"):
        return Value(v.col.isin(items.const), BOOL)
    return Value(F.exists(items.col, lambda x: equal(Value(x, t), v).col), BOOL)


def truth(v: Value) -> Column:
    """v as a condition of AND and OR: what is no boolean counts as false."""
    if v.type == BOOL:
        return v.col
    if v.type.kind == "null":
        return F.lit(None).cast("boolean")
    if v.type == ANY:
        return F.when(v.col.isNotNull(), F.coalesce(v.col["as_bool"], F.lit(False)))
    return F.when(v.col.isNotNull(), F.lit(False))


def negate(v: Value) -> Value:
    if v.type.kind == "null":
        return null(BOOL)
    if v.type == ANY:
        return Value(F.when(v.col.isNotNull() & v.col["as_bool"].isNull(), F.raise_error(F.lit("NOT takes a boolean")).cast("boolean")).otherwise(~v.col["as_bool"]), BOOL)
    if v.type != BOOL:
        raise CypherTypeError(f"NOT takes a boolean, not a {v.type.kind}")
    return Value(~v.col, BOOL)


def case(operand: Value | None, whens: list[tuple[Value, Value]], default: Value | None) -> Value:
    results = [r for _, r in whens] + ([default] if default else [])
    t = reduce(lambda p, q: common(p, q, "CASE results"), (r.type for r in results))
    out = None
    for w, r in whens:
        condition = truth(w) if operand is None else equal(operand, w).col
        out = F.when(condition, convert(r, t).col) if out is None else out.when(condition, convert(r, t).col)
    return Value(out.otherwise(convert(default, t).col) if default else out, t)


def text_test(op: str, a: Value, b: Value) -> Value:
    a, b = (Value(v.col["as_str"], STR) if v.type == ANY else v for v in (a, b))
    if a.type.kind != "str" or b.type.kind != "str":
        return null(BOOL)
    if op == "=~":
        return Value(F.rlike(a.col, F.concat(F.lit("^(?:"), b.col, F.lit(")\\z"))), BOOL)
    return Value({"STARTS WITH": a.col.startswith, "ENDS WITH": a.col.endswith, "CONTAINS": a.col.contains}[op](b.col), BOOL)
