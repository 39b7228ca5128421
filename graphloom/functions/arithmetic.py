"""Numbers, and + on strings and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..types import ANY, FLOAT, INT, NULL, SCALARS, STR, CypherTypeError, Value, common, convert, list_of, null, spark_type
from .comparison import number_of


def calculate(op: str, a: Value, b: Value, strict: bool = False) -> Value:
    """a op b; null where one is null, or an error of the query if `strict`."""
    x, y = a.type, b.type
    if strict and "list" not in (x.kind, y.kind):
        if NULL in (x, y):
            raise CypherTypeError(f"{op} has no meaning for null")
        v = calculate(op, a, b)
        wrong = F.raise_error(F.lit(f"{op} has no meaning for null")).cast(spark_type(v.type))
        return Value(F.when(a.col.isNull() | b.col.isNull(), wrong).otherwise(v.col), v.type)
    if op == "+" and "list" in (x.kind, y.kind):
        if x.kind == y.kind == "list":
            t = common(x, y, "list items")
            return Value(F.concat(convert(a, t).col, convert(b, t).col), t)
        if x.kind == "list":
            t = common(x, list_of(y), "list items")
            return Value(F.array_append(convert(a, t).col, convert(b, t.item).col), t)
        t = common(list_of(x), y, "list items")
        return Value(F.array_prepend(convert(b, t).col, convert(a, t.item).col), t)
    if NULL in (x, y):
        return null(y if x == NULL else x)
    if op == "+" and x == y == STR:
        return Value(F.concat(a.col, b.col), STR)
    if ANY in (x, y) and {x.kind, y.kind} <= {"any", *(t.kind for t in SCALARS.values())}:
        return _by_value(op, convert(a, ANY).col, convert(b, ANY).col)
    if not (x.number and y.number):
        raise CypherTypeError(f"{op} has no meaning for {x.kind} and {y.kind}")
    if op == "%":
        if FLOAT in (x, y):
            raise CypherTypeError("% takes integers")
        return Value(a.col % b.col, INT)
    t = common(x, y)
    p, q = convert(a, t).col, convert(b, t).col
    if op == "/":
        return Value(F.call_function("div", p, q) if t == INT else p / q, t)
    return Value({"+": p + q, "-": p - q, "*": p * q}[op], t)


def _by_value(op: str, p, q) -> Value:
    """Arithmetic on what two values of any hold; kinds that it has no meaning for are an error of the query."""
    out = F.when(p.isNull() | q.isNull(), F.lit(None).cast(spark_type(ANY)))
    out = out.when(p["as_int"].isNotNull() & q["as_int"].isNotNull(), convert(calculate(op, Value(p["as_int"], INT), Value(q["as_int"], INT)), ANY).col)
    if op == "+":
        out = out.when(p["as_str"].isNotNull() & q["as_str"].isNotNull(), convert(Value(F.concat(p["as_str"], q["as_str"]), STR), ANY).col)
    if op != "%":
        m, n = number_of(p), number_of(q)
        out = out.when(m.isNotNull() & n.isNotNull(), convert(calculate(op, Value(m, FLOAT), Value(n, FLOAT)), ANY).col)
    return Value(out.otherwise(F.raise_error(F.lit(f"{op} has no meaning for these values")).cast(spark_type(ANY))), ANY)


def minus(v: Value, strict: bool = False) -> Value:
    if strict:
        return calculate("-", Value(F.lit(0).cast("long"), INT), v, True)
    if v.type == ANY:
        return _by_value("-", convert(Value(F.lit(0).cast("long"), INT), ANY).col, v.col)
    if v.type == NULL:
        return v
    if not v.type.number:
        raise CypherTypeError(f"- takes a number, not a {v.type.kind}")
    if v.known and v.const is not None:
        return Value(F.lit(-v.const).cast("long" if v.type == INT else "double"), v.type, True, -v.const)
    return Value(-v.col, v.type)
