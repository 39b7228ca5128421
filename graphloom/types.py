"""Static types of expressions, and their values as Spark columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CypherTypeError(TypeError):
    """An expression that has no meaning for the types of its parts."""


@dataclass(frozen=True)
class Type:
    """kind: null, bool, int, float, str, time, any, list, map, node, rel, path; any: one of `SCALARS`, a list or a map, told row by row."""

    kind: str
    item: "Type | None" = None
    fields: tuple[tuple[str, "Type"], ...] = ()

    @property
    def number(self) -> bool:
        return self.kind in ("int", "float")

    @property
    def entity(self) -> bool:
        return self.kind in ("node", "rel")

    def field(self, key: str) -> "Type | None":
        return dict(self.fields).get(key)


NULL, BOOL, INT, FLOAT, STR, TIME, PATH, ANY = (Type(k) for k in ("null", "bool", "int", "float", "str", "time", "path", "any"))

#: A value of any is a struct of these and of a list or map as JSON; one of them is not null.
SCALARS = {"as_bool": BOOL, "as_int": INT, "as_float": FLOAT, "as_str": STR}
NESTED = "as_json"


def list_of(item: Type) -> Type:
    return Type("list", item)


@dataclass(frozen=True)
class Value:
    """A column with its type; known: a constant, whose Python value is `const`."""

    col: Column
    type: Type
    known: bool = False
    const: Any = None


def null(t: Type = NULL) -> Value:
    return Value(F.lit(None).cast(spark_type(t)), t, True, None)


def spark_type(t: Type) -> T.DataType:
    match t.kind:
        case "null":
            return T.NullType()
        case "bool":
            return T.BooleanType()
        case "int":
            return T.LongType()
        case "float":
            return T.DoubleType()
        case "str":
            return T.StringType()
        case "time":
            return T.TimestampNTZType()
        case "any":
            return T.StructType([*(T.StructField(k, spark_type(x)) for k, x in SCALARS.items()), T.StructField(NESTED, T.StringType())])
        case "list":
            return T.ArrayType(spark_type(t.item))
        case "map":
            return T.StructType([T.StructField(k, spark_type(v)) for k, v in t.fields] or [T.StructField("_", T.BooleanType())])  # files hold no empty struct
        case "node":
            return T.StructType([T.StructField("id", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("props", spark_type(replace(t, kind="map")))])
        case "rel":
            return T.StructType([T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("props", spark_type(replace(t, kind="map")))])
    raise CypherTypeError(f"no column holds a {t.kind}")


def type_of(d: T.DataType) -> Type:
    """The static type of a stored column."""
    if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(d, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(d, T.BooleanType):
        return BOOL
    if isinstance(d, (T.StringType, T.BinaryType)):
        return STR
    if isinstance(d, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIME
    if isinstance(d, T.ArrayType):
        return list_of(type_of(d.elementType))
    if isinstance(d, T.StructType) and d.fieldNames() == [*SCALARS, NESTED]:
        return ANY
    if isinstance(d, T.StructType):
        return Type("map", fields=tuple((f.name, type_of(f.dataType)) for f in d.fields))
    if isinstance(d, T.NullType):
        return NULL
    raise CypherTypeError(f"columns of type {d.simpleString()} are not supported")


def widened(c: Column, d: T.DataType) -> Column:
    """A stored column as the type that expressions work on."""
    t = type_of(d)
    return c if t.kind in ("time", "any", "list", "map") or spark_type(t) == d else c.cast(spark_type(t))


def common(a: Type, b: Type, what: str = "values") -> Type:
    """The type that holds both."""
    if a == b or b.kind == "null":
        return a
    if a.kind == "null":
        return b
    if a.number and b.number:
        return FLOAT
    if a.kind == b.kind == "list":
        return list_of(common(a.item, b.item, what))
    if a.kind == b.kind and a.kind in ("map", "node", "rel"):
        keys = dict.fromkeys([k for k, _ in a.fields] + [k for k, _ in b.fields])
        return Type(a.kind, fields=tuple((k, common(a.field(k) or NULL, b.field(k) or NULL, what)) for k in keys))
    if {a.kind, b.kind} <= {"any", "list", "map", *(x.kind for x in SCALARS.values())}:
        return ANY
    raise CypherTypeError(f"{what} of types {a.kind} and {b.kind} do not mix")


def struct_of(*fields: Column) -> Column:
    return F.struct(*fields) if fields else F.struct(F.lit(None).cast("boolean").alias("_"))


def convert(v: Value, t: Type) -> Value:
    """v as a value of a type that holds it."""
    if v.type == t:
        return v
    if v.type.kind == "null":
        return Value(F.lit(None).cast(spark_type(t)), t, True, None)
    if t == ANY:
        arms = [(v.col if x == v.type else F.lit(None).cast(spark_type(x))).alias(k) for k, x in SCALARS.items()]
        nested = json_text(v) if v.type.kind in ("list", "map") else F.lit(None).cast("string")
        return Value(F.when(v.col.isNotNull(), F.struct(*arms, nested.alias(NESTED))), ANY)
    if t.kind == "list":
        return Value(F.transform(v.col, lambda x: convert(Value(x, v.type.item), t.item).col), t)
    if t.kind in ("map", "node", "rel"):
        source = v.col if t.kind == "map" else v.col["props"]
        props = struct_of(*[(convert(Value(source[k], v.type.field(k)), x).col if v.type.field(k) else F.lit(None).cast(spark_type(x))).alias(k) for k, x in t.fields])
        if t.kind != "map":
            head = ("id", "labels") if t.kind == "node" else ("id", "type", "src", "dst")
            props = F.struct(*[v.col[h].alias(h) for h in head], props.alias("props"))
        return Value(F.when(v.col.isNotNull(), props), t)
    const = float(v.const) if v.known and t.kind == "float" and v.const is not None else v.const
    return Value(v.col.cast(spark_type(t)), t, v.known, const)


def json_text(v: Value) -> Column:
    """A list or map as JSON with sorted keys; kinds of values are told by how they are written.  NaN and infinities are null."""
    c, kind = v.col, v.type.kind
    if kind == "null":
        return F.lit("null")
    if kind in ("bool", "int"):
        out = c.cast("string")
    elif kind == "float":
        out = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("string"))
    elif kind in ("str", "time"):
        out = F.regexp_extract(F.to_json(F.array(c.cast("string"))), r"(?s)^\[(.*)\]$", 1)
    elif kind == "any":
        out = F.coalesce(c[NESTED], *[F.when(c[k].isNotNull(), json_text(Value(c[k], t))) for k, t in SCALARS.items()])
    elif kind == "list":
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(Value(x, v.type.item))), ","), F.lit("]"))
    elif kind == "map":
        parts = [F.concat(F.lit(json.dumps(k) + ":"), json_text(Value(c[k], t))) for k, t in sorted(v.type.fields)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    else:
        raise CypherTypeError(f"a {kind} does not mix with other kinds in a list or map")
    return F.when(c.isNotNull(), F.coalesce(out, F.lit("null"))).otherwise("null")


def _of_variant(x: Column) -> Column:
    """A parsed JSON value as one of any."""
    kind = F.schema_of_variant(x)
    number = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    arms = {"as_bool": (kind == "BOOLEAN", "boolean"), "as_int": (kind == "BIGINT", "bigint"), "as_float": (number, "double"), "as_str": (kind == "STRING", "string")}
    cols = [F.when(some, F.try_variant_get(x, "$", t)).alias(k) for k, (some, t) in arms.items()]
    nested = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(x))
    return F.when(kind != "VOID", F.struct(*cols, nested.alias(NESTED)))


def holds_list(c: Column) -> Column:
    return F.coalesce(c[NESTED].startswith("["), F.lit(False))


def elements(c: Column) -> Column:
    """The elements of the list that a value of any holds, as values of any; null if it holds none."""
    return F.when(holds_list(c), F.transform(F.try_variant_get(F.parse_json(c[NESTED]), "$", "array<variant>"), _of_variant))


def as_list(v: Value, what: str) -> Value:
    """A value of any as the list that it must hold; others as they are."""
    if v.type != ANY:
        return v
    wrong = F.raise_error(F.lit(f"{what} takes a list")).cast(spark_type(list_of(ANY)))
    return Value(F.when(v.col.isNotNull() & ~holds_list(v.col), wrong).otherwise(elements(v.col)), list_of(ANY))


def key_of(v: Value, key: str) -> Value:
    """What the map that a value of any must hold has under a key."""
    is_map = F.coalesce(v.col[NESTED].startswith("{"), F.lit(False))
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    wrong = F.raise_error(F.lit(f"only a map or an entity has a {key}")).cast(spark_type(ANY))
    found = F.try_variant_get(F.parse_json(v.col[NESTED]), f"$['{quoted}']", "variant")
    return Value(F.when(v.col.isNotNull() & ~is_map, wrong).when(is_map & found.isNotNull(), _of_variant(found)), ANY)


def plain(x: Any) -> Any:
    """A collected value with those of any as the Python values that they hold."""
    if hasattr(x, "asDict") and list(x.asDict()) == [*SCALARS, NESTED]:
        if x[NESTED] is not None:
            return json.loads(x[NESTED])
        return next((v for v in x if v is not None), None)
    return [plain(y) for y in x] if isinstance(x, list) else x


def literal(x: Any) -> Value:
    """A Python value as a constant."""
    if x is None:
        return null()
    if isinstance(x, bool):
        return Value(F.lit(x), BOOL, True, x)
    if isinstance(x, int):
        if not -(2**63) <= x < 2**63:
            raise CypherTypeError(f"{x} is out of range")
        return Value(F.lit(x).cast("long"), INT, True, x)
    if isinstance(x, float):
        return Value(F.lit(x), FLOAT, True, x)
    if isinstance(x, str):
        return Value(F.lit(x), STR, True, x)
    if hasattr(x, "asDict"):
        fields = set(x.asDict())
        if fields == {*SCALARS, NESTED}:
            return literal(plain(x))
        if fields in ({"id", "labels", "props"}, {"id", "type", "src", "dst", "props"}):
            return _entity(x)
        return literal(x.asDict(recursive=True))
    if isinstance(x, (list, tuple)):
        return replace(make_list([literal(y) for y in x]), known=True, const=list(x))
    if isinstance(x, dict):
        return replace(make_map([(str(k), literal(v)) for k, v in x.items()]), known=True, const=x)
    if hasattr(x, "isoformat"):
        return Value(F.lit(x), TIME, True, x)
    raise CypherTypeError(f"a {type(x).__name__} is no parameter value")


def _entity(x: Any) -> Value:
    """A node or relationship of an earlier result, as it was then."""
    props = literal({k: v for k, v in x["props"].asDict(recursive=True).items() if k != "_"})
    kind = "node" if "labels" in x.asDict() else "rel"
    if kind == "node":
        head = [F.lit(x["id"]).cast("long").alias("id"), F.array(*[F.lit(v) for v in x["labels"]]).cast("array<string>").alias("labels")]
    else:
        head = [F.lit(x["id"]).cast("long").alias("id"), F.lit(x["type"]).alias("type"), F.lit(x["src"]).cast("long").alias("src"), F.lit(x["dst"]).cast("long").alias("dst")]
    return Value(F.struct(*head, props.col.alias("props")), Type(kind, fields=props.type.fields))


def make_list(items: list[Value]) -> Value:
    t = NULL
    for v in items:
        t = common(t, v.type, "list items")
    cols = [convert(v, t).col for v in items]
    known = all(v.known for v in items)
    return Value(F.array(*cols) if cols else F.array().cast(T.ArrayType(spark_type(t))), list_of(t), known, [v.const for v in items] if known else None)


def make_map(items: list[tuple[str, Value]]) -> Value:
    return Value(struct_of(*[v.col.alias(k) for k, v in items]), Type("map", fields=tuple((k, v.type) for k, v in items)))
