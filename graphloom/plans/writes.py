"""Write clauses over a staged snapshot.

Rows before a write are computed once; ids are then dealt densely.  A write
changes the staged tables, and what the rows know of nodes and relationships is
read again from them, so later clauses see it.  All rows are written, also
under a LIMIT.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cypher import syntax as S
from ..errors import NodeHasRelationships, SchemaError
from ..runtime import cut
from ..sources.store import Snapshot, Table, check_unique, storable
from ..types import INT, NULL, STR, CypherTypeError, Value, convert, spark_type
from .compiler import Compiler, Rows
from .scope import Binding, Node, Plain, Rel, fresh


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, with a dense number from 0; the driver gets one count a partition."""
    at = fresh("m")
    kept = cut(df.withColumn(at, F.monotonically_increasing_id()))
    counts = {r["p"]: r["n"] for r in kept.groupBy(F.shiftright(at, 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, base = 0, {}
    for p in sorted(counts):
        base[p] = before
        before += counts[p]
    # Within a partition numbers are consecutive from its first.
    offset = reduce(lambda e, p: e.when(F.shiftright(at, 33) == p, F.lit(base[p])), sorted(base), F.when(F.lit(False), F.lit(0)))
    return kept.withColumn(name, (offset + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop(at)


class Writer(Compiler):
    """Compiles clauses against a staged snapshot that writes change."""

    def __init__(self, spark: SparkSession, staged: Snapshot, params: Mapping[str, object] | None = None, strict: bool = False):
        super().__init__(spark, staged.graph(), params, strict)
        self.staged = staged

    def _stage(self, nodes: Table | None = None, rels: Table | None = None, **more) -> None:
        self.staged = replace(self.staged, **({"nodes": nodes} if nodes else {}), **({"rels": rels} if rels else {}), **more)
        self.graph = self.staged.graph()

    def _uses(self, clauses):
        uses = super()._uses(clauses)
        self.whole |= {x.path for c in clauses for x in S.parts_of(c) if isinstance(x, S.Part) and x.path}
        uses["*"] += 1  # a later clause may read what is bound here
        return uses

    def clause(self, c: S.Clause, rows: Rows) -> Rows:
        match c:
            case S.Create(parts):
                return self.create(parts, self._ready(rows))
            case S.Set(items) | S.Remove(items):
                return self.set(items, self._ready(rows), isinstance(c, S.Remove))
            case S.Delete(exprs, detach):
                return self.delete(exprs, detach, self._ready(rows))
            case S.Merge():
                return self.merge(c, self._ready(rows))
            case S.Schema():
                return self.schema(c)
        return super().clause(c, rows)

    def _ready(self, rows: Rows) -> Rows:
        """Rows computed once, numbered in `row`."""
        df = rows.df if rows.df is not None else self.unit()
        keep = list(dict.fromkeys(c for b in rows.scope.values() for c in b.columns())) + ([rows.order] if rows.order else [])
        self.row = fresh("row")
        return replace(rows, df=numbered(df.select(*keep) if keep else self._bare(df), self.row))

    @staticmethod
    def _bare(df: DataFrame) -> DataFrame:
        return df.select(F.lit(0).alias(fresh("unit")))

    def _again(self, rows: Rows) -> Rows:
        """Rows with what is known of their nodes and relationships read again."""
        df, scope = rows.df, dict(rows.scope)
        for name, b in rows.scope.items():
            if isinstance(b, (Node, Rel)):
                df, scope[name] = self._attach(df, b.id, isinstance(b, Node))
        return replace(rows, df=df, scope=scope)

    def _attach(self, df: DataFrame, id_: str, node: bool) -> tuple[DataFrame, Binding]:
        t = self.staged.nodes if node else self.staged.rels
        names = {c: fresh("w") for c in t.df.columns}
        other = t.df.select(*[F.col(c).alias(n) for c, n in names.items()])
        df = df.join(other, F.col(id_) == F.col(names["id"]), "left")
        props = tuple((k, names[c], x) for k, (c, x) in t.props.items())
        if node:
            return df, Node(names["id"], names["labels"], props)
        return df, Rel(names["id"], names["type"], names["src"], names["dst"], props)

    # CREATE.

    def _values(self, props: S.MapOf | None, scope) -> dict[str, Value]:
        out = {}
        for k, e in props.items if props else ():
            v = self.x.value(e, scope)
            t = storable(k, v.type)
            if v.type.kind != "null":
                out[k] = convert(v, t)
        return out

    @staticmethod
    def _insert(table: Table, rows: DataFrame, fixed: dict[str, object], values: dict[str, Value]) -> Table:
        wide = table.with_props({k: v.type for k, v in values.items()})
        cols = [c.alias(n) for n, c in fixed.items()]
        for k, (c, t) in wide.props.items():
            cols.append((convert(values[k], t).col if k in values else F.lit(None).cast(spark_type(t))).alias(c))
        return wide.added(rows.select(*cols))

    def create(self, parts: tuple[S.Part, ...], rows: Rows) -> Rows:
        df, scope = rows.df, dict(rows.scope)
        count = df.count()
        nodes, rels = self.staged.nodes, self.staged.rels
        next_node, next_rel = self.staged.next_node, self.staged.next_rel
        new: dict[str, tuple[str, bool]] = {}
        todo = []
        for p in parts:
            ids = []
            for n in p.nodes:
                b = scope.get(n.var) if n.var else None
                if n.var in new:
                    ids.append(new[n.var][0])
                elif isinstance(b, Node):
                    ids.append(b.id)
                elif b is not None:
                    raise CypherTypeError(f"{n.var} is no node")
                else:
                    c = fresh("n")
                    df = df.withColumn(c, F.lit(next_node) + F.col(self.row))
                    next_node += count
                    todo.append((True, c, n, ()))
                    ids.append(c)
                    new[n.var or c] = (c, True)
            for i, r in enumerate(p.rels):
                c = fresh("r")
                df = df.withColumn(c, F.lit(next_rel) + F.col(self.row))
                next_rel += count
                a, b = (ids[i], ids[i + 1]) if r.direction == "out" else (ids[i + 1], ids[i])
                todo.append((False, c, r, (a, b)))
                new[r.var or c] = (c, False)
        for is_node, c, pattern, ends in todo:
            values = self._values(pattern.props, scope)
            if is_node:
                labels = F.array(*[F.lit(x) for x in pattern.labels]).cast("array<string>")
                nodes = self._insert(nodes, df, {"id": F.col(c), "labels": labels}, values)
            else:
                a, b = (F.col(e) for e in ends)
                some = F.when(a.isNotNull() & b.isNotNull(), a).otherwise(F.raise_error(F.lit("a relationship needs two nodes")).cast("long"))
                rels = self._insert(rels, df, {"id": F.col(c), "type": F.lit(pattern.types[0]), "src": some, "dst": b}, values)
        made = {x for x, *_ in todo}
        self._stage(nodes.kept() if True in made else None, rels.kept() if False in made else None, next_node=next_node, next_rel=next_rel)
        for name, (c, is_node) in new.items():
            scope[name] = Node(c, None) if is_node else Rel(c, c, c, c)
        return self._again(replace(rows, df=df, scope={n: b for n, b in scope.items() if n not in {c for c, _ in new.values()}}))

    # SET and REMOVE.

    def set(self, items: tuple[S.SetItem, ...], rows: Rows, remove: bool = False, only: str | None = None) -> Rows:
        for i in items:
            rows = self._set_one(i, rows, remove, only)
        return rows

    def _set_one(self, i: S.SetItem, rows: Rows, remove: bool, only: str | None) -> Rows:
        if not isinstance(i.target, S.Var):
            raise CypherTypeError("SET changes nodes and relationships")
        b = rows.scope.get(i.target.name)
        if isinstance(b, Plain) and b.type.kind == "null":
            return rows
        if not isinstance(b, (Node, Rel)):
            raise CypherTypeError(f"SET cannot change {i.target.name}")
        is_node = isinstance(b, Node)
        table = self.staged.nodes if is_node else self.staged.rels
        picked = rows.df.where(F.col(b.id).isNotNull() & (F.col(only) if only else F.lit(True)))
        if i.kind == "labels":
            if not is_node:
                raise CypherTypeError("a relationship has no labels")
            ids = cut(picked.select(F.col(b.id).alias("id")).distinct())
            some = F.array(*[F.lit(x) for x in i.labels])
            changed = F.array_except("labels", some) if remove else F.array_union("labels", some)
            return self._changed(rows, is_node, table.changed(ids, table.df.join(ids, "id", "left_semi").withColumn("labels", changed)))
        if i.kind == "prop":
            v = Value(F.lit(None), NULL) if remove else self.x.value(i.value, rows.scope)
            values, clear = {i.key: v}, False
        else:
            v = self.x.value(i.value, rows.scope)
            if v.type.kind == "null":
                if i.kind == "merge":
                    return rows
                values = {}
            elif v.type.kind in ("map", "node", "rel"):
                source = v.col if v.type.kind == "map" else v.col["props"]
                values = {k: Value(source[k], t) for k, t in v.type.fields}
            else:
                raise CypherTypeError(f"SET takes a map, not a {v.type.kind}")
            clear = i.kind == "replace"
        types = {k: storable(k, v.type) for k, v in values.items() if v.type.kind != "null"}
        wide = table.with_props(types)
        values = {k: v for k, v in values.items() if k in wide.props}
        cols = {k: fresh("v") for k in values}
        struct = F.struct(*[(convert(v, wide.props[k][1]).col if v.type.kind != "null" else F.lit(None).cast(spark_type(wide.props[k][1]))).alias(cols[k]) for k, v in values.items()], F.lit(1).alias("#set"))
        last = cut(picked.groupBy(F.col(b.id).alias("id")).agg(F.max_by(struct, self.row).alias("#v")))
        df = wide.df.join(last, "id")
        for k, (c, t) in wide.props.items():
            if k in values:
                df = df.withColumn(c, F.col("#v")[cols[k]])
            elif clear:
                df = df.withColumn(c, F.lit(None).cast(spark_type(t)))
        return self._changed(rows, is_node, wide.changed(last.select("id"), df.drop("#v")))

    def _changed(self, rows: Rows, is_node: bool, table: Table) -> Rows:
        table = table.kept()
        self._stage(**{"nodes" if is_node else "rels": table})
        return self._again(rows)

    # DELETE.

    def delete(self, exprs: tuple[S.Expr, ...], detach: bool, rows: Rows) -> Rows:
        nodes, rels = [], []
        for e in exprs:
            v = self.x.value(e, rows.scope)
            if v.type.kind == "null":
                continue
            if v.type.kind == "node":
                nodes.append(rows.df.select(v.col["id"].alias("x")))
            elif v.type.kind == "rel":
                rels.append(rows.df.select(v.col["id"].alias("x")))
            elif v.type.kind == "path":
                nodes.append(rows.df.select(F.explode(F.transform(v.col["nodes"], lambda n: n["id"])).alias("x")))
                rels.append(rows.df.select(F.explode(F.transform(v.col["rels"], lambda r: r["id"])).alias("x")))
            elif v.type.kind == "list" and v.type.item.kind in ("node", "rel"):
                (nodes if v.type.item.kind == "node" else rels).append(rows.df.select(F.explode(F.transform(v.col, lambda x: x["id"])).alias("x")))
            else:
                raise CypherTypeError(f"DELETE takes nodes and relationships, not a {v.type.kind}")
        staged_nodes, staged_rels = self.staged.nodes, self.staged.rels
        if rels:
            staged_rels = staged_rels.without(cut(reduce(DataFrame.union, rels).where("x is not null").distinct().toDF("id")))
        if nodes:
            gone = cut(reduce(DataFrame.union, nodes).where("x is not null").distinct())
            left = staged_rels.df
            touched = left.join(gone, F.col("src") == F.col("x"), "left_semi").select("id").union(left.join(gone, F.col("dst") == F.col("x"), "left_semi").select("id"))
            if detach:
                staged_rels = staged_rels.without(cut(touched.distinct()))
            elif not touched.limit(1).isEmpty():
                raise NodeHasRelationships("a node with relationships is only deleted by DETACH DELETE")
            staged_nodes = staged_nodes.without(gone.toDF("id"))
        if nodes or rels:
            self._stage(staged_nodes.kept(), staged_rels.kept())
        return rows

    # MERGE.

    def merge(self, c: S.Merge, rows: Rows) -> Rows:
        """Rows that match bind all matches; of the others, the first of each key creates and the rest match what it made."""
        p, scope = c.part, rows.scope
        keys: dict[str, Value] = {}
        for pattern in (*p.nodes, *p.rels):
            bound = isinstance(pattern, S.NodePattern) and isinstance(scope.get(pattern.var), Node)
            if bound:
                keys[fresh("k")] = Value(F.col(scope[pattern.var].id), INT)
                continue
            for k, e in pattern.props.items if pattern.props else ():
                v = self.x.value(e, scope)
                if v.type.kind == "null":
                    raise CypherTypeError(f"MERGE with a null {k}")
                some = F.when(v.col.isNotNull(), v.col).otherwise(F.raise_error(F.lit(f"MERGE with a null {k}")).cast(rows.df.select(v.col.alias("x")).schema["x"].dataType))
                keys[fresh("k")] = Value(some, v.type)
        row = self.row
        base = cut(rows.df.withColumns({n: v.col for n, v in keys.items()}) if keys else rows.df)
        start = replace(rows, df=base)
        new = [x.var for x in (*p.nodes, *p.rels) if x.var and x.var not in scope]
        found = self.match((p,), None, start)
        columns = base.columns
        ids = {n: fresh("id") for n in new}
        matched = cut(found.df.select(*columns, *[F.col(found.scope[n].id).alias(i) for n, i in ids.items()]))
        rest = cut(base.join(matched.select(F.col(row).alias("#r")).distinct(), F.col(row) == F.col("#r"), "left_anti"))
        made = None
        if not rest.isEmpty():
            by = list(keys)
            first = rest.groupBy(*by).agg(F.min(row).alias("#first"))
            makers = rest.join(first.select("#first"), F.col(row) == F.col("#first"), "left_semi")
            self.row = fresh("row")
            created = self.create((p,), replace(start, df=numbered(makers, self.row)))
            to = {k: fresh("k") for k in by}
            got = created.df.select(F.col(row).alias("#maker"), *[F.col(k).alias(to[k]) for k in by], *[F.col(created.scope[n].id).alias(i) for n, i in ids.items()])
            on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(to[k])) for k in by], F.lit(True))
            made = rest.join(got, on).select(*columns, *ids.values(), (F.col(row) == F.col("#maker")).alias("#new"))
        every = matched.withColumn("#new", F.lit(False))
        if made is not None:
            every = every.unionByName(made)
        flag = fresh("new")
        self.row = fresh("row")
        every = numbered(every.withColumnRenamed("#new", flag), self.row)
        kinds = {x.var: isinstance(x, S.NodePattern) for x in (*p.nodes, *p.rels)}
        scope = {**scope, **{n: Node(i, None) if kinds[n] else Rel(i, i, i, i) for n, i in ids.items()}}
        out = self._again(replace(rows, df=every, scope=scope))
        out = self.set(c.on_create, out, only=flag)
        if c.on_match:
            out = replace(out, df=out.df.withColumn(old := fresh("old"), ~F.col(flag)))
            out = self.set(c.on_match, out, only=old)
        return out

    # Indexes and constraints.

    def schema(self, c: S.Schema) -> Rows:
        s = self.staged.copy()
        match c.action:
            case "create index":
                name = c.name or f"{'index' if c.entity == 'NODE' else 'rel_index'}_{c.label}_{c.key}"
                entry = (c.label, c.key, c.entity)
                if entry not in s.indexes.values():
                    if name in s.indexes or name in s.constraints:
                        raise SchemaError(f"the name {name} is taken")
                    s.indexes[name] = entry
            case "drop index":
                if c.name not in s.indexes:
                    if not c.lenient:
                        raise SchemaError(f"no index {c.name}")
                elif any(own == c.name or (label, key, "NODE") == s.indexes[c.name] for label, key, own in s.constraints.values()):
                    raise SchemaError(f"index {c.name} belongs to a constraint")
                else:
                    del s.indexes[c.name]
            case "create constraint":
                name = c.name or f"constraint_{c.label}_{c.key}"
                there = [n for n, x in s.constraints.items() if x[:2] == (c.label, c.key)]
                if not there:
                    if name in s.constraints or name in s.indexes:
                        raise SchemaError(f"the name {name} is taken")
                    own = None
                    if (c.label, c.key, "NODE") not in s.indexes.values():
                        own = f"index_{c.label}_{c.key}"
                        s.indexes[own] = (c.label, c.key, "NODE")
                    s.constraints[name] = (c.label, c.key, own)
                    check_unique(s)
                elif not c.lenient and c.name and c.name not in there:
                    raise SchemaError(f"constraint {there[0]} is there already")
            case "drop constraint":
                if c.name not in s.constraints:
                    if not c.lenient:
                        raise SchemaError(f"no constraint {c.name}")
                else:
                    own = s.constraints.pop(c.name)[2]
                    if own:
                        s.indexes.pop(own, None)
            case "show indexes":
                rows = [(n, *x) for n, x in sorted(s.indexes.items())]
                return self._listed(rows, ("name", "label", "property", "entity"))
            case "show constraints":
                rows = [(n, x[0], x[1], "UNIQUE") for n, x in sorted(s.constraints.items())]
                return self._listed(rows, ("name", "label", "property", "type"))
        self.staged = s
        return Rows(None, {})

    def _listed(self, rows: list[tuple], names: tuple[str, ...]) -> Rows:
        cols = [fresh("x") for _ in names]
        df = self.spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
        return Rows(df, {n: Plain(c, STR) for n, c in zip(names, cols)})

