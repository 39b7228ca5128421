"""A graph that can be written: versions of Parquet tables with a change log.

A version is a manifest that names, for nodes and for relationships, a base
table and what later commits changed of it: rows that were added or changed, and
ids of older rows that are gone.  A commit writes what it changes, and the
change log of that, and then creates the next version's manifest, which names
them all: the file system lets one writer create it, any other conflicts.  So
the cost of a commit grows with the change, and a version is never visible
without its changes.  Now and then a commit merges what has piled up.  Old
versions stay readable, so a reader keeps its snapshot.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, ConstraintViolation, TransactionTooLarge, WriteOutcomeUnknown
from ..functions.comparison import same_key
from ..runtime import Folder, cut, shared_folder
from ..types import ANY, CypherTypeError, Type, Value, common, convert, list_of, spark_type
from .graph import Graph, NodeTable, RelTable


def _pack(t: Type):
    return [t.kind, _pack(t.item) if t.item else None, [[k, _pack(v)] for k, v in t.fields]]


def _unpack(x) -> Type:
    return Type(x[0], _unpack(x[1]) if x[1] else None, tuple((k, _unpack(v)) for k, v in x[2]))


@dataclass
class Table:
    """Rows with one column a property; names of properties are kept apart from those of columns, which know no case.

    base: the rows of a version; gone: ids of those that have been changed or
    deleted since; rows: what has been added or changed since.
    """

    base: DataFrame
    props: dict[str, tuple[str, Type]] = field(default_factory=dict)
    rows: DataFrame | None = None
    gone: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        old = self.base if self.gone is None else self.base.join(self.gone, "id", "left_anti")
        return old if self.rows is None else old.unionByName(self.rows)

    def columns(self) -> tuple:
        return tuple((k, F.col(c), t) for k, (c, t) in self.props.items())

    def with_props(self, more: dict[str, Type]) -> "Table":
        """The same rows with columns for these properties, wide enough for these types."""
        props, cols = dict(self.props), {}
        for key, t in more.items():
            if key not in props:
                props[key] = (f"p{len(props)}", t)
                cols[props[key][0]] = F.lit(None).cast(spark_type(t))
            else:
                c, old = props[key]
                if old.kind == "list" and t.kind == "list" and old.item.kind == "null":
                    new = t
                else:
                    new = common(old, t, f"values of property {key}")
                if new != old:
                    cols[c] = convert(Value(F.col(c), old), new).col.cast(spark_type(new))
                    props[key] = (c, new)
        if not cols:
            return self
        return Table(self.base.withColumns(cols), props, self.rows.withColumns(cols) if self.rows is not None else None, self.gone)

    def added(self, rows: DataFrame) -> "Table":
        """With rows of new ids."""
        return replace(self, rows=rows if self.rows is None else self.rows.unionByName(rows))

    def without(self, ids: DataFrame) -> "Table":
        """Without the rows of these ids."""
        left = self.rows.join(ids, "id", "left_anti") if self.rows is not None else None
        return replace(self, rows=left, gone=ids if self.gone is None else self.gone.union(ids).distinct())

    def changed(self, ids: DataFrame, rows: DataFrame) -> "Table":
        """With these rows in place of those of these ids."""
        return self.without(ids).added(rows)

    def kept(self) -> "Table":
        """With what has changed computed once."""
        return replace(self, rows=cut(self.rows) if self.rows is not None else None, gone=cut(self.gone) if self.gone is not None else None)

    @property
    def touched(self) -> bool:
        return self.rows is not None or self.gone is not None


STORABLE = ("bool", "int", "float", "str", "time", "any", "list", "map")


def storable(key: str, t: Type) -> Type:
    if t.kind not in STORABLE and t.kind != "null":
        raise CypherTypeError(f"property {key} cannot hold a {t.kind}")
    if t.kind == "list" and t.item.kind == "null":
        return list_of(Type("str"))
    return t


@dataclass
class Snapshot:
    version: int
    nodes: Table
    rels: Table
    next_node: int = 1
    next_rel: int = 1
    indexes: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # name: label or type, key, entity
    constraints: dict[str, tuple[str, str, str | None]] = field(default_factory=dict)  # name: label, key, own index

    def graph(self) -> Graph:
        n = NodeTable(self.nodes.df, F.col("id"), "labels", self.nodes.columns())
        r = RelTable(self.rels.df, F.col("id"), "@type", F.col("src"), F.col("dst"), None, None, self.rels.columns())
        return Graph([n], [r])

    def copy(self) -> "Snapshot":
        return replace(self, indexes=dict(self.indexes), constraints=dict(self.constraints))


NODE_DDL, REL_DDL = "id long, labels array<string>", "id long, type string, src long, dst long"
CHANGES_DDL = "version long, entity string, id long, src long, dst long, kinds array<string>, structural boolean, keys array<string>"


#: A table has at most so many changes beside its base before they are merged.
MOST_SEGMENTS = 8


class Store:
    """A folder of versions.  Without a path, one in the session's shared folder.

    max_rows: a commit that changes more rows of a table is refused; None for
    no limit.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, max_rows: int | None = None):
        self.spark, self.max_rows = spark, max_rows
        self.path = path or f"{shared_folder(spark)}/graphloom/store-{uuid.uuid4().hex}"
        self.versions = Folder(spark, f"{self.path}/versions")
        if self.latest() is None:
            empty = [self._segment(spark.createDataFrame([], ddl), {}, name) for ddl, name in ((NODE_DDL, "nodes"), (REL_DDL, "rels"))]
            self._publish(Snapshot(0, Table(spark.createDataFrame([], NODE_DDL)), Table(spark.createDataFrame([], REL_DDL))), [empty[0]], [empty[1]], None)

    def latest(self) -> int | None:
        return max((int(n.removesuffix(".json")) for n in self.versions.names() if n.endswith(".json")), default=None)

    # Files.

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _segment(self, rows: DataFrame, props: dict, name: str, gone: DataFrame | None = None, by: tuple[str, ...] = ()) -> dict:
        """What a manifest says of rows, written with the ids that they replace; columns have the types of this version.

        by: columns of indexed keys.  Rows lie in ranges of the first, so that
        file statistics clear most of a seek; all have Bloom filters.
        """
        options = {}
        for c in by:
            options |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": "100000"}
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        (rows.repartitionByRange(by[0], "id").sortWithinPartitions(by[0], "id") if by else rows).write.options(**options).parquet(path)
        return {"rows": path, "gone": self._write(gone, "gone") if gone is not None else None, "n": self.spark.read.schema(rows.schema).parquet(path).count(), "props": {k: [c, _pack(t)] for k, (c, t) in props.items()}}

    def _publish(self, s: Snapshot, nodes: list[dict], rels: list[dict], changes: str | None) -> None:
        pack = lambda t: {k: [c, _pack(x)] for k, (c, x) in t.props.items()}
        text = json.dumps(
            {"version": s.version, "nodes": nodes, "rels": rels, "changes": changes, "node_props": pack(s.nodes), "rel_props": pack(s.rels), "next_node": s.next_node, "next_rel": s.next_rel, "indexes": s.indexes, "constraints": s.constraints}
        )
        try:
            done = self.versions.create(f"{s.version}.json", text)
        except Exception as e:
            raise WriteOutcomeUnknown(f"whether version {s.version} was committed is not known: {e}") from e
        if not done:
            raise ConflictError(f"version {s.version} was committed by another writer")

    def _manifest(self, version: int) -> dict:
        return json.loads(self.versions.read(f"{version}.json"))

    def _read(self, segment: dict, ddl: str, props: dict[str, tuple[str, Type]]) -> DataFrame:
        """The rows of a segment with the columns of props."""
        have = {k: (c, _unpack(t)) for k, (c, t) in segment["props"].items()}
        columns = "".join(f", {c} {spark_type(t).simpleString()}" for c, t in have.values())
        df = self.spark.read.schema(ddl + columns).parquet(segment["rows"])
        own = [F.col(c.split()[0]) for c in ddl.split(", ")]
        for k, (c, t) in props.items():
            old = have.get(k)
            if old is None:
                own.append(F.lit(None).cast(spark_type(t)).alias(c))
            else:
                own.append((F.col(c) if old[1] == t else _widened(F.col(c), old[1], t)).alias(c))
        return df.select(*own)

    def _table(self, segments: list[dict], ddl: str, props: dict[str, tuple[str, Type]]) -> Table:
        df = self._read(segments[0], ddl, props)
        for s in segments[1:]:
            if s["gone"]:
                df = df.join(self.spark.read.schema("id long").parquet(s["gone"]), "id", "left_anti")
            df = df.unionByName(self._read(s, ddl, props))
        return Table(df, props)

    @staticmethod
    def _indexed(s: Snapshot, entity: str) -> tuple[str, ...]:
        """Columns of the keys that indexes name, where their values have an order in files."""
        props = (s.nodes if entity == "NODE" else s.rels).props
        keys = dict.fromkeys(key for _, key, e in s.indexes.values() if e == entity and key in props and props[key][1].kind in ("int", "float", "str", "time"))
        return tuple(props[k][0] for k in keys)

    def _extended(self, segments: list[dict], table: Table, ddl: str, name: str, by: tuple[str, ...], anew: bool) -> list[dict]:
        """The segments with what the table has changed; merged if there are many or much, or (anew) if the layout has changed."""
        if not table.touched:
            return [self._segment(table.df, table.props, name, by=by)] if anew and by else segments
        rows = table.rows if table.rows is not None else table.base.limit(0)
        made = [*segments, self._segment(rows, table.props, name, table.gone)]
        if self.max_rows is not None and made[-1]["n"] > self.max_rows:
            raise TransactionTooLarge(f"the transaction changes {made[-1]['n']} {name}, more than {self.max_rows}")
        if anew and by or 2 * sum(s["n"] for s in made[1:]) > made[0]["n"]:
            return [self._segment(self._table(made, ddl, table.props).df, table.props, name, by=by)]
        if len(made) > MOST_SEGMENTS:
            gone = [self.spark.read.schema("id long").parquet(s["gone"]) for s in made[1:] if s["gone"]]
            return [made[0], self._segment(self._table(made[1:], ddl, table.props).df, table.props, name, reduce(DataFrame.union, gone).distinct() if gone else None)]
        return made

    # Versions.

    def snapshot(self, version: int | None = None) -> Snapshot:
        m = self._manifest(self.latest() if version is None else version)
        props = {side: {k: (c, _unpack(t)) for k, (c, t) in m[f"{side}_props"].items()} for side in ("node", "rel")}
        return Snapshot(m["version"], self._table(m["nodes"], NODE_DDL, props["node"]), self._table(m["rels"], REL_DDL, props["rel"]), m["next_node"], m["next_rel"], {k: tuple(v) for k, v in m["indexes"].items()}, {k: tuple(v) for k, v in m["constraints"].items()})

    def commit(self, old: Snapshot, new: Snapshot) -> Snapshot:
        """Publish `new`, which was made from `old`, as the version after it: unique values hold, the change log has what differs."""
        new = replace(new, version=old.version + 1)
        check_unique(new, changed=True)
        if self.latest() != old.version:
            raise ConflictError(f"version {new.version} was committed by another writer")
        parts = [c for a, b, e in ((old.nodes, new.nodes, "node"), (old.rels, new.rels, "rel")) if (c := _changes(a, b, e)) is not None]
        changes = None
        if parts:
            changed = reduce(DataFrame.unionByName, parts).withColumn("version", F.lit(new.version).cast("long"))
            changes = self._write(changed.select(*[c.split()[0] for c in CHANGES_DDL.split(", ")]), "changes")
        m = self._manifest(old.version)
        laid = {e: (self._indexed(old, e), self._indexed(new, e)) for e in ("NODE", "RELATIONSHIP")}
        nodes, rels = ((now, set(now) - set(before) != set()) for before, now in (laid["NODE"], laid["RELATIONSHIP"]))
        self._publish(new, self._extended(m["nodes"], new.nodes, NODE_DDL, "nodes", *nodes), self._extended(m["rels"], new.rels, REL_DDL, "rels", *rels), changes)
        return self.snapshot(new.version)

    def backup(self, path: str) -> "Store":
        """The latest version as a store of its own under another path."""
        s = self.snapshot()
        other = Store(self.spark, path)
        whole = lambda t: Table(self.spark.createDataFrame([], t.df.schema), t.props, t.df)
        other.commit(other.snapshot(), replace(s, nodes=whole(s.nodes), rels=whole(s.rels)))
        return other

    def changed_since(self, version: int, upto: int) -> DataFrame:
        """The change log of the versions after `version`, as their manifests name it."""
        paths = [p for v in range(version + 1, upto + 1) if (p := self._manifest(v)["changes"])]
        return self.spark.read.schema(CHANGES_DDL).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGES_DDL)


def check_unique(s: Snapshot, changed: bool = False) -> None:
    """Fail if nodes share a value that is unique; changed: only values of nodes that have been changed can."""
    if changed and s.nodes.rows is None:
        return
    for name, (label, key, _) in s.constraints.items():
        if key not in s.nodes.props:
            continue
        c, t = s.nodes.props[key]
        if t.kind in ("list", "map"):
            continue
        value = same_key(Value(F.col(c), t)) if t == ANY else F.col(c)

        def values(df: DataFrame) -> DataFrame:
            rows = df.where(F.array_contains("labels", label) & F.col(c).isNotNull())
            if t.kind == "float":
                rows = rows.where(~F.isnan(c))
            return rows.select(value.alias("value")).where("value is not null")

        found = values(s.nodes.df)
        if changed:
            found = found.join(values(s.nodes.rows).distinct(), "value", "left_semi")
        if not found.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").limit(1).isEmpty():
            raise ConstraintViolation(f"constraint {name}: nodes of :{label} share a value of {key}")


def _widened(c, old: Type, new: Type):
    return convert(Value(c, old), new).col.cast(spark_type(new))


def _as_of(new: Table, key: str, c: str, t: Type):
    """A property's column in the type that it has in a later version."""
    if key not in new.props or new.props[key][1] == t:
        return F.col(c)
    return _widened(F.col(c), t, new.props[key][1])


def _changes(old: Table, new: Table, entity: str) -> DataFrame | None:
    """What differs between two versions of a table: created, deleted and changed rows with the keys that changed."""
    if not new.touched:
        return None
    ends = ["src", "dst"] if entity == "rel" else []
    kinds = "labels" if entity == "node" else "type"
    keys = list(dict.fromkeys([*old.props, *new.props]))

    def side(df: DataFrame, t: Table, mark: str) -> DataFrame:
        values = []
        for i, k in enumerate(keys):
            c = F.to_json(F.struct(_as_of(new, k, *t.props[k]).alias("v"))) if k in t.props else F.lit("{}")
            values.append(c.alias(f"{mark}v{i}"))
        what = F.col(kinds) if entity == "node" else F.array(F.col(kinds))
        return df.select(F.col("id").alias(f"{mark}id"), what.alias(f"{mark}kinds"), *[F.col(e).alias(f"{mark}{e}") for e in ends], *values)

    before = old.df.join(new.gone, "id", "left_semi") if new.gone is not None else old.df.limit(0)
    after = new.rows if new.rows is not None else new.base.limit(0)
    both = side(before, old, "a_").join(side(after, new, "b_"), F.col("a_id") == F.col("b_id"), "full")
    one_sided = F.col("a_id").isNull() | F.col("b_id").isNull()
    relabelled = F.coalesce(F.sort_array("a_kinds") != F.sort_array("b_kinds"), F.lit(False))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a_v{i}").eqNullSafe(F.col(f"b_v{i}")), F.lit(k)) for i, k in enumerate(keys)]).cast("array<string>"))
    out = both.select(
        F.lit(entity).alias("entity"),
        F.coalesce("b_id", "a_id").alias("id"),
        *[(F.coalesce(f"b_{e}", f"a_{e}") if ends else F.lit(None)).cast("long").alias(e) for e in ("src", "dst")],
        F.array_union(F.coalesce("a_kinds", F.array().cast("array<string>")), F.coalesce("b_kinds", F.array().cast("array<string>"))).alias("kinds"),
        (one_sided | relabelled).alias("structural"),
        changed.alias("keys"),
    )
    return out.where(F.col("structural") | (F.size("keys") > 0))
