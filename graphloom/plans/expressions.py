"""Expressions to columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cypher import syntax as S
from ..functions import arithmetic, comparison, library
from ..types import ANY, BOOL, INT, NULL, STR, CypherTypeError, Value, as_list, key_of, list_of, literal, make_list, make_map, null
from .scope import Binding, Bound, Node, Rel


class Expressions:
    """Compiles expressions over a scope.  given: values that stand for whole expressions (grouping keys, aggregates)."""

    def __init__(self, params: Mapping[str, object], graph=None, strict: bool = False):
        self.params, self.graph, self.strict = params, graph, strict

    def constant(self, e: S.Expr) -> int:
        """The integer of SKIP or LIMIT."""
        match e:
            case S.Lit(v):
                x = v
            case S.Param(name):
                x = self._param(name)
            case S.Unary("-", of):
                return -self.constant(of)
            case S.Binary(("+" | "-" | "*") as op, a, b):
                p, q = self.constant(a), self.constant(b)
                return p + q if op == "+" else p - q if op == "-" else p * q
            case _:
                raise CypherTypeError("SKIP and LIMIT take an integer")
        if isinstance(x, bool) or not isinstance(x, int):
            raise CypherTypeError("SKIP and LIMIT take an integer")
        return x

    def _param(self, name: str):
        if name not in self.params:
            raise CypherTypeError(f"parameter ${name} is missing")
        return self.params[name]

    def condition(self, e: S.Expr, scope: Mapping[str, Binding]) -> Column:
        """True where e is true."""
        return comparison.truth(self.value(e, scope))

    def value(self, e: S.Expr, scope: Mapping[str, Binding], given: Mapping[S.Expr, Value] | None = None) -> Value:
        if given and e in given:
            return given[e]
        go = lambda x: self.value(x, scope, given)
        match e:
            case S.Lit(v):
                return literal(v)
            case S.Param(name):
                return literal(self._param(name))
            case S.Var(name):
                if name not in scope:
                    raise CypherTypeError(f"{name} is not grouped")
                return scope[name].value()
            case S.Prop(of, key):
                return self._prop(of, key, scope, given)
            case S.Index(of, at):
                return self._index(go(of), at, go)
            case S.Slice(of, low, high):
                return self._slice(go(of), go(low) if low else None, go(high) if high else None)
            case S.ListOf(items):
                v = make_list([go(x) for x in items])
                return v
            case S.MapOf(items):
                return make_map([(k, go(v)) for k, v in items])
            case S.Comprehension(var, source, where, result):
                return self._comprehension(var, go(source), where, result, scope, given)
            case S.Quantifier(kind, var, source, where):
                return self._quantifier(kind, var, go(source), where, scope, given)
            case S.Case(operand, whens, default):
                return comparison.case(go(operand) if operand else None, [(go(a), go(b)) for a, b in whens], go(default) if default else None)
            case S.Call(name, args):
                return self._call(e, name, args, scope, go)
            case S.Unary(op, of):
                v = go(of)
                if op == "NOT":
                    return comparison.negate(v)
                if op == "-":
                    return arithmetic.minus(v, self.strict)
                if isinstance(of, S.Var) and isinstance(scope.get(of.name), (Node, Rel)) and not (given and of in given):
                    v = Value(F.col(scope[of.name].id), INT)
                return Value(v.col.isNull() if op == "IS NULL" else v.col.isNotNull(), BOOL)
            case S.HasLabels(of, labels):
                return self._has_labels(of, labels, scope, go)
            case S.Binary(op, a, b):
                return self._binary(op, a, b, scope, given, go)
        raise CypherTypeError(f"cannot compile {S.show(e)}")

    def _binary(self, op: str, a: S.Expr, b: S.Expr, scope, given, go) -> Value:
        if op in ("=", "<>"):
            ids = [scope.get(x.name) if isinstance(x, S.Var) and not (given and x in given) else None for x in (a, b)]
            if all(isinstance(x, Node) for x in ids):
                v = Value(F.col(ids[0].id) == F.col(ids[1].id), BOOL)
            else:
                v = comparison.equal(go(a), go(b))
            return v if op == "=" else Value(~v.col, BOOL)
        x, y = go(a), go(b)
        if op in ("<", "<=", ">", ">="):
            return comparison.compare(op, x, y)
        if op == "AND":
            return Value(comparison.truth(x) & comparison.truth(y), BOOL)
        if op == "OR":
            return Value(comparison.truth(x) | comparison.truth(y), BOOL)
        if op == "IN":
            return comparison.member(x, y)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS", "=~"):
            return comparison.text_test(op, x, y)
        return arithmetic.calculate(op, x, y, self.strict)

    def _prop(self, of: S.Expr, key: str, scope, given) -> Value:
        if isinstance(of, S.Var) and isinstance(scope.get(of.name), (Node, Rel)) and not (given and of in given):
            return scope[of.name].prop(key)
        return field(self.value(of, scope, given), key)

    def _index(self, v: Value, at: S.Expr, go) -> Value:
        if v.type.kind in ("map", "node", "rel"):
            k = go(at)
            if not k.known or k.type not in (STR, NULL):
                raise CypherTypeError("a map or entity is indexed by a constant string")
            return null() if k.const is None else field(v, k.const)
        i = go(at)
        if v.type == ANY and i.type == STR and i.known:
            return null() if i.const is None else key_of(v, i.const)
        v = as_list(v, "an index")
        if NULL in (v.type, i.type):
            return null()
        if v.type.kind != "list" or i.type != INT:
            raise CypherTypeError(f"a {v.type.kind} has no [{i.type.kind}]")
        place = F.when(i.col >= 0, i.col + 1).otherwise(i.col)
        inside = (place <= F.size(v.col)) & (place >= -F.size(v.col))
        return Value(F.when(inside, F.try_element_at(v.col, place.cast("int"))), v.type.item)

    @staticmethod
    def _slice(v: Value, low: Value | None, high: Value | None) -> Value:
        if v.type == NULL or low and low.type == NULL or high and high.type == NULL:
            return null(v.type)
        v = as_list(v, "a slice")
        if v.type.kind != "list" or any(x and x.type != INT for x in (low, high)):
            raise CypherTypeError("a slice takes a list and integers")
        n = F.size(v.col).cast("long")

        def clamp(x: Value | None, default: Column) -> Column:
            if x is None:
                return default
            return F.greatest(F.lit(0).cast("long"), F.least(n, F.when(x.col < 0, x.col + n).otherwise(x.col)))

        a, b = clamp(low, F.lit(0).cast("long")), clamp(high, n)
        cut = F.slice(v.col, (a + 1).cast("int"), F.greatest(b - a, F.lit(0).cast("long")).cast("int"))
        known = reduce(lambda p, q: p & q, [x.col.isNotNull() for x in (low, high) if x], v.col.isNotNull())
        return Value(F.when(known, cut), v.type)

    def _comprehension(self, var, source: Value, where, result, scope, given) -> Value:
        if source.type == NULL:
            return null()
        source = as_list(source, "a comprehension")
        if source.type.kind != "list":
            raise CypherTypeError("a comprehension takes a list")
        t = source.type.item
        col = source.col
        inner = lambda x: {**scope, var: Bound(Value(x, t))}
        if where is not None:
            col = F.filter(col, lambda x: comparison.truth(self.value(where, inner(x), given)))
        if result is None:
            return Value(col, source.type)
        kind: list = []

        def one(x):
            v = self.value(result, inner(x), given)
            kind.append(v.type)
            return v.col

        out = F.transform(col, one)
        return Value(out, list_of(kind[0]))

    def _quantifier(self, kind, var, source: Value, where, scope, given) -> Value:
        if source.type == NULL:
            return null(BOOL)
        source = as_list(source, kind)
        if source.type.kind != "list":
            raise CypherTypeError(f"{kind} takes a list")
        test = lambda x: comparison.truth(self.value(where, {**scope, var: Bound(Value(x, source.type.item))}, given))
        if kind == "any":
            return Value(F.exists(source.col, test), BOOL)
        if kind == "all":
            return Value(F.forall(source.col, test), BOOL)
        if kind == "none":
            return Value(~F.exists(source.col, test), BOOL)
        true, unknown = F.size(F.filter(source.col, test)), F.exists(source.col, lambda x: test(x).isNull())
        return Value(F.when(source.col.isNull(), F.lit(None).cast("boolean")).when(true > 1, False).when(unknown, F.lit(None).cast("boolean")).otherwise(true == 1), BOOL)

    def _call(self, e: S.Call, name: str, args, scope, go) -> Value:
        low = name.lower()
        if S.is_aggregate(e):
            raise CypherTypeError(f"aggregate {name} is not allowed here")
        if len(args) == 1 and isinstance(args[0], S.Var):
            b = scope.get(args[0].name)
            if isinstance(b, (Node, Rel)) and low == "id":
                return Value(F.col(b.id), INT)
            if isinstance(b, Node) and low == "labels":
                return Value(b.labels_col(), list_of(STR))
            if isinstance(b, Rel) and low == "type":
                return Value(F.col(b.type), STR)
        if low in ("startnode", "endnode"):
            raise CypherTypeError(f"{name} takes a relationship variable")
        return library.call(name, [go(a) for a in args])

    def _has_labels(self, of, labels, scope, go) -> Value:
        b = scope.get(of.name) if isinstance(of, S.Var) else None
        if isinstance(b, Node):
            has, some = b.labels_col(), F.col(b.id).isNotNull()
            if isinstance(b.labels, tuple):
                return Value(some if set(labels) <= set(b.labels) else F.lit(False), BOOL)
        else:
            v = go(of)
            if v.type.kind != "node":
                return Value(F.lit(False), BOOL)
            has = v.col["labels"]
        return Value(F.coalesce(reduce(lambda p, q: p & q, [F.array_contains(has, x) for x in labels]), F.lit(False)), BOOL)


def field(v: Value, key: str) -> Value:
    """A key of a map, node or relationship value; null if it is not there."""
    if v.type == NULL:
        return null()
    if v.type.kind == "map":
        t = v.type.field(key)
        return Value(v.col[key], t) if t else null()
    if v.type.entity:
        t = v.type.field(key)
        return Value(v.col["props"][key], t) if t else null()
    if v.type == ANY:
        return key_of(v, key)
    raise CypherTypeError(f"a {v.type.kind} has no property {key}")
