"""The scalar functions by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ANY, FLOAT, INT, NULL, SCALARS, STR, CypherTypeError, Type, Value, common, convert, elements, holds_list, list_of, null, spark_type

#: range() makes at most this many numbers (a fixed limit of the language's engine).
RANGE_LIMIT = 10_000_000
#: Unicode white space, as a class of Java regular expressions.
WHITE = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

REGISTRY: dict[str, tuple[int, int, Callable[..., Value]]] = {}


def _function(name: str, low: int, high: int | None = None):
    def keep(f):
        REGISTRY[name.lower()] = (low, low if high is None else high, f)
        return f

    return keep


def _want(v: Value, *kinds: str, of: str) -> None:
    if v.type.kind not in (*kinds, "null"):
        raise CypherTypeError(f"{of} takes a {' or '.join(kinds)}, not a {v.type.kind}")


def call(name: str, args: list[Value]) -> Value:
    if name.lower() not in REGISTRY:
        raise CypherTypeError(f"unknown function {name}")
    low, high, f = REGISTRY[name.lower()]
    if not low <= len(args) <= high:
        raise CypherTypeError(f"{name} takes {low}{'' if low == high else f' to {high}'} arguments, not {len(args)}")
    if name.lower() != "coalesce":
        for i, v in enumerate(args):
            if v.type == ANY:
                return _by_value(name, v, lambda x: call(name, [*args[:i], x, *args[i + 1 :]]))
    return f(*args)


def _by_value(name: str, v: Value, f: Callable[[Value], Value]) -> Value:
    """f of what a value of any holds; a kind that f does not take is an error of the query."""
    found = []
    for k, t in SCALARS.items():
        try:
            found.append((v.col[k].isNotNull(), f(Value(v.col[k], t))))
        except CypherTypeError:
            continue
    try:
        found.append((holds_list(v.col), f(Value(elements(v.col), list_of(ANY)))))
    except CypherTypeError:
        pass
    if not found:
        raise CypherTypeError(f"{name} takes no plain value")
    t = reduce(common, (r.type for _, r in found))
    out = F.when(v.col.isNull(), F.lit(None).cast(spark_type(t)))
    for some, r in found:
        out = out.when(some, convert(r, t).col)
    return Value(out.otherwise(F.raise_error(F.lit(f"{name} has no meaning for this value")).cast(spark_type(t))), t)


def _when_some(v: Value, c: Column) -> Column:
    return F.when(v.col.isNotNull(), c)


# Entities.


@_function("id", 1)
def _id(v):
    _want(v, "node", "rel", of="id")
    return null(INT) if v.type == NULL else Value(v.col["id"], INT)


@_function("labels", 1)
def _labels(v):
    _want(v, "node", of="labels")
    return null(list_of(STR)) if v.type == NULL else Value(v.col["labels"], list_of(STR))


@_function("type", 1)
def _type(v):
    _want(v, "rel", of="type")
    return null(STR) if v.type == NULL else Value(v.col["type"], STR)


@_function("keys", 1)
def _keys(v):
    _want(v, "node", "rel", "map", of="keys")
    if v.type == NULL:
        return null(list_of(STR))
    if v.type.kind == "map":
        return Value(_when_some(v, F.array(*[F.lit(k) for k, _ in sorted(v.type.fields)]).cast("array<string>")), list_of(STR))
    names = [F.when(v.col["props"][k].isNotNull(), F.lit(k)) for k in sorted(k for k, _ in v.type.fields)]
    return Value(_when_some(v, F.array_compact(F.array(*names).cast("array<string>"))), list_of(STR))


@_function("properties", 1)
def _properties(v):
    _want(v, "node", "rel", "map", of="properties")
    if v.type.kind in ("null", "map"):
        return v
    return Value(v.col["props"], Type("map", fields=v.type.fields))


@_function("nodes", 1)
def _nodes(v):
    _want(v, "path", of="nodes")
    return null() if v.type == NULL else Value(v.col["nodes"], list_of(v.type.field("nodes")))


@_function("relationships", 1)
def _relationships(v):
    _want(v, "path", of="relationships")
    return null() if v.type == NULL else Value(v.col["rels"], list_of(v.type.field("rels")))


# Sizes and conversions.


def _count(v: Value, of: str, path: bool) -> Value:
    _want(v, "list", "str", *(("path",) if path else ()), of=of)
    if v.type == NULL:
        return null(INT)
    if v.type.kind == "path":
        return Value(_when_some(v, F.size(v.col["rels"])).cast("long"), INT)
    return Value((F.char_length(v.col) if v.type == STR else _when_some(v, F.size(v.col))).cast("long"), INT)


REGISTRY["size"] = (1, 1, lambda v: _count(v, "size", False))
REGISTRY["length"] = (1, 1, lambda v: _count(v, "length", True))


@_function("toInteger", 1)
def _to_integer(v):
    _want(v, "int", "float", "str", "bool", of="toInteger")
    match v.type.kind:
        case "null":
            return null(INT)
        case "float":
            inside = ~F.isnan(v.col) & (v.col >= -(2.0**63)) & (v.col < 2.0**63)
            return Value(F.when(inside, v.col.cast("long")), INT)
        case "str":
            clean = F.regexp_replace(v.col, f"^{WHITE}+|{WHITE}+$", "")
            return Value(F.when(clean.rlike(r"^[+-]?[0-9]+\z"), clean.try_cast("long")), INT)
    return Value(v.col.cast("long"), INT)


@_function("toFloat", 1)
def _to_float(v):
    _want(v, "int", "float", "str", of="toFloat")
    if v.type == STR:
        clean = F.regexp_replace(v.col, f"^{WHITE}+|{WHITE}+$", "")
        fits = clean.rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z|^[+-]?(inf|infinity|nan)\z")
        return Value(F.when(fits, clean.try_cast("double")), FLOAT)
    return convert(v, FLOAT)


def float_text(c: Column) -> Column:
    """The shortest digits that give the number back; plain from 1e-4 to below 1e6, else with an exponent of two digits or more."""
    digits = F.regexp_replace(F.regexp_extract(c.cast("string"), r"^-?([0-9.]+)", 1), r"[.]", "")
    digits = F.regexp_replace(digits, "^0+|0+$", "")
    power = F.floor(F.log10(F.abs(c))).cast("int")  # may be one off at powers of ten
    power = F.when(F.pow(F.lit(10.0), power + 1) <= F.abs(c), power + 1).when(F.pow(F.lit(10.0), power) > F.abs(c), power - 1).otherwise(power)
    rest = digits.substr(F.lit(2), F.length(digits))
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)))
    size = F.abs(power).cast("string")
    science = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.when(F.length(size) < 2, "0").otherwise(""), size)
    zeros = F.repeat(F.lit("0"), power + 1 - F.length(digits))
    below = digits.substr(power + 2, F.length(digits))
    large = F.when(F.length(digits) <= power + 1, F.concat(digits, zeros)).otherwise(F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), below))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when(power >= 0, large).otherwise(small)
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.when((power >= -4) & (power < 6), plain).otherwise(science))
    zero = F.when(c.cast("string").startswith("-"), "-0").otherwise("0")
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf").when(c == 0, zero).otherwise(text)


@_function("toString", 1)
def _to_string(v):
    _want(v, "int", "float", "str", "bool", "time", of="toString")
    return Value(float_text(v.col) if v.type == FLOAT else v.col.cast("string"), STR)


# Strings.


def _string(name: str, f: Callable[[Column], Column]) -> None:
    def run(v: Value) -> Value:
        _want(v, "str", of=name)
        return Value(f(v.col.cast("string")), STR)

    REGISTRY[name.lower()] = (1, 1, run)


#: Letters whose capital alone is more than one letter, but that have a title form of one: it stands for the capital.
_MANY = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and len(chr(c).upper()) > 1 and len(chr(c).title()) == 1]
_TITLE = "".join(c.title() for c in _MANY)


def _letterwise(f: Callable[[Column], Column], many: str, one: str) -> Callable[[Column], Column]:
    """f letter by letter, where each stays one: those that f makes more of are looked up, or else stay as they are."""

    def letter(x: Column) -> Column:
        return F.when(F.char_length(f(x)) == 1, f(x)).otherwise(F.translate(x, many, one))

    return lambda c: F.when(c.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(c, ""), letter), "")).otherwise(f(c))


_string("toUpper", _letterwise(F.upper, "".join(_MANY), _TITLE))
_string("toLower", _letterwise(F.lower, "\u0130", "i"))
_string("trim", lambda c: F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", ""))


@_function("substring", 2, 3)
def _substring(s, start, length=None):
    _want(s, "str", of="substring")
    for n in (start, length):
        if n is not None:
            _want(n, "int", of="substring")
    if NULL in (s.type, start.type) or length is not None and length.type == NULL:
        return null(STR)
    at = F.greatest(start.col, F.lit(0)).cast("int") + 1
    n = F.greatest(length.col, F.lit(0)).cast("int") if length is not None else F.char_length(s.col)
    known = s.col.isNotNull() & start.col.isNotNull() & (length.col.isNotNull() if length is not None else F.lit(True))
    return Value(F.when(known, s.col.substr(at, n)), STR)


@_function("replace", 3)
def _replace(s, a, b):
    for v in (s, a, b):
        _want(v, "str", of="replace")
    if NULL in (s.type, a.type, b.type):
        return null(STR)
    between = F.concat(b.col, F.array_join(F.transform(F.split(s.col, ""), lambda x: F.concat(x, b.col)), ""))
    between = F.when(s.col == "", b.col).otherwise(between)
    return Value(F.when(a.col == "", between).otherwise(F.replace(s.col, a.col, b.col)), STR)


@_function("split", 2)
def _split(s, by):
    for v in (s, by):
        _want(v, "str", of="split")
    if NULL in (s.type, by.type):
        return null(list_of(STR))
    quoted = F.concat(F.lit("\\Q"), F.replace(by.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    letters = F.when(s.col == "", F.array().cast("array<string>")).otherwise(F.split(s.col, ""))
    return Value(F.when(by.col == "", letters).otherwise(F.split(s.col, quoted, -1)), list_of(STR))


# Lists.


def _pick(name: str, at: int):
    def run(v: Value) -> Value:
        _want(v, "list", of=name)
        return null() if v.type == NULL else Value(F.try_element_at(v.col, F.lit(at)), v.type.item)

    REGISTRY[name] = (1, 1, run)


_pick("head", 1)
_pick("last", -1)


@_function("tail", 1)
def _tail(v):
    _want(v, "list", of="tail")
    return v if v.type == NULL else Value(F.slice(v.col, F.lit(2), F.greatest(F.size(v.col) - 1, F.lit(0))), v.type)


@_function("range", 2, 3)
def _range(a, b, step=None):
    for v in (a, b, step):
        if v is not None:
            _want(v, "int", of="range")
    s = step.col if step is not None else F.lit(1).cast("long")
    if NULL in (a.type, b.type) or step is not None and step.type == NULL:
        return null(list_of(INT))
    empty = F.array().cast("array<bigint>")
    safe = F.when(s == 0, F.raise_error(F.lit("range() takes no step of 0")).cast("long")).otherwise(s)
    count = F.call_function("div", b.col - a.col, safe) + 1
    full = F.when(count > RANGE_LIMIT, F.raise_error(F.lit(f"range() makes at most {RANGE_LIMIT} numbers")).cast("array<bigint>"))
    full = full.when(F.signum((b.col - a.col).cast("double")) * F.signum(safe.cast("double")) < 0, empty).otherwise(F.sequence(a.col, F.when(F.signum((b.col - a.col).cast("double")) * F.signum(safe.cast("double")) < 0, a.col).otherwise(b.col), safe))
    return Value(full, list_of(INT))


@_function("coalesce", 1, 255)
def _coalesce(*args):
    t = reduce(lambda p, q: common(p, q, "coalesce arguments"), (a.type for a in args))
    return Value(F.coalesce(*[convert(a, t).col for a in args]), t)


# Numbers.


def _number(name: str, f: Callable[[Column], Column], t: Type | None) -> None:
    def run(v: Value) -> Value:
        _want(v, "int", "float", of=name)
        if v.type == NULL:
            return null(t or FLOAT)
        return Value(f(v.col if t is None else v.col.cast("double")), t or v.type)

    REGISTRY[name.lower()] = (1, 1, run)


def _edge(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding of doubles that are beyond a long, or no number, leaves them as they are."""
    return lambda c: F.when(F.isnan(c) | (F.abs(c) >= 2.0**52), c).otherwise(f(c).cast("double"))


_number("abs", F.abs, None)
_number("round", _edge(lambda c: F.floor(c + 0.5)), FLOAT)
_number("floor", _edge(F.floor), FLOAT)
_number("ceil", _edge(F.ceil), FLOAT)
_number("sqrt", F.sqrt, FLOAT)
_number("sign", lambda c: F.when(F.isnan(c), 0).otherwise(F.signum(c)).cast("long"), INT)
REGISTRY["rand"] = (0, 0, lambda: Value(F.rand(), FLOAT))
REGISTRY["timestamp"] = (0, 0, lambda: Value(F.unix_millis(F.current_timestamp()), INT))
