"""Node and relationship scans with columns of their own names."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scope import Node, Rel, fresh
from ..sources.graph import Graph, NodeTable, RelTable
from ..types import CypherTypeError, Type, Value, common, convert, spark_type


def _shape(tables: Iterable[NodeTable | RelTable]) -> dict[str, Type]:
    """The type of every property over all tables; `mixed` where tables disagree."""
    out: dict[str, Type] = {}
    for t in tables:
        for key, _, kind in t.props:
            try:
                out[key] = common(out[key], kind) if key in out and out[key].kind != "mixed" else out.get(key, kind)
            except CypherTypeError:
                out[key] = Type("mixed")
    return out


def _select(t: NodeTable | RelTable, shape: dict[str, Type], names: dict[str, str]) -> list:
    have = {k: (c, kind) for k, c, kind in t.props}
    out = []
    for key, kind in shape.items():
        if kind.kind == "mixed":
            c = have[key][0].cast("string") if key in have else F.lit(None).cast("string")
        elif key in have:
            c = convert(Value(*have[key]), kind).col
        else:
            c = F.lit(None).cast(spark_type(kind))
        out.append(c.alias(names[key]))
    return out


def scan_nodes(spark: SparkSession, graph: Graph, labels: tuple[str, ...], among: frozenset[frozenset[str]] | None = None) -> tuple[DataFrame, Node]:
    """All nodes with all the labels; an unknown label has none.  among: only tables of these sets of labels, where tables tell."""
    tables = [t for t in graph.nodes if isinstance(t.labels, str) or set(labels) <= set(t.labels) and (among is None or frozenset(t.labels) in among)]
    shape = _shape(tables)
    names = {k: fresh("p") for k in shape}
    id_, lab = fresh("n"), fresh("l")
    parts = []
    for t in tables:
        df = t.df
        if isinstance(t.labels, str):
            for x in labels:
                df = df.where(F.array_contains(t.labels, x))
            has = F.col(t.labels)
        else:
            has = F.array(*[F.lit(x) for x in t.labels]).cast("array<string>")
        parts.append(df.select(t.id.alias(id_), has.alias(lab), *_select(t, shape, names)))
    if not parts:
        parts = [spark.createDataFrame([], f"{id_} long, {lab} array<string>")]
    df = reduce(DataFrame.unionByName, parts)
    one = tables[0].labels if len(tables) == 1 and not isinstance(tables[0].labels, str) else lab
    return df, Node(id_, one, tuple((k, names[k], t) for k, t in shape.items()))


def ends_of(tables: Iterable[RelTable], side: str) -> frozenset[frozenset[str]] | None:
    """The sets of labels that the relationships' ends (side: src or dst) have; None if a table does not tell."""
    found = [t.src_labels if side == "src" else t.dst_labels for t in tables]
    return None if any(f is None for f in found) else frozenset(found)


def rel_tables(graph: Graph, types: tuple[str, ...]) -> list[RelTable]:
    return [t for t in graph.rels if not types or t.type in types or t.type.startswith("@")]


def scan_rels(spark: SparkSession, tables: list[RelTable], types: tuple[str, ...], direction: str) -> tuple[DataFrame, Rel, str, str]:
    """Relationships with the columns that they are followed from and to; undirected ones both ways, loops once."""
    shape = _shape(tables)
    names = {k: fresh("p") for k in shape}
    id_, type_, src, dst, start, end = (fresh(x) for x in ("r", "t", "s", "d", "from", "to"))
    parts = []
    for t in tables:
        df = t.df
        if t.type.startswith("@"):
            kind = F.col(t.type[1:])
            if types:
                df = df.where(kind.isin(list(types)))
        else:
            kind = F.lit(t.type)
        df = df.select(t.id.alias(id_), kind.alias(type_), t.src.alias(src), t.dst.alias(dst), *_select(t, shape, names))
        parts.append(df)
    if not parts:
        parts = [spark.createDataFrame([], f"{id_} long, {type_} string, {src} long, {dst} long")]
    df = reduce(DataFrame.unionByName, parts)
    out = df.withColumns({start: F.col(src), end: F.col(dst)})
    back = df.withColumns({start: F.col(dst), end: F.col(src)})
    rel = Rel(id_, type_, src, dst, tuple((k, names[k], t) for k, t in shape.items()), ends_of(tables, "src"), ends_of(tables, "dst"))
    if direction == "both":
        out = out.unionByName(back.where(F.col(src) != F.col(dst)))
    return (back if direction == "in" else out), rel, start, end


def own_end(tables: list[RelTable], direction: str, side: str) -> NodeTable | None:
    """The node table whose rows the relationships are, for the end that they are followed from or to."""
    if len(tables) != 1 or direction == "both":
        return None
    return tables[0].src_table if (direction == "out") == (side == "from") else tables[0].dst_table


def scan_rels_with_end(table: RelTable, direction: str, side: str) -> tuple[DataFrame, Rel, str, str, Node]:
    """Relationships as `scan_rels` gives them, and the node at one end from the same rows, without a join."""
    node = own_end([table], direction, side)
    shape, ends = _shape([table]), _shape([node])
    names, own = {k: fresh("p") for k in shape}, {k: fresh("p") for k in ends}
    id_, type_, src, dst, start, end = (fresh(x) for x in ("r", "t", "s", "d", "from", "to"))
    a, b = (table.src, table.dst) if direction == "out" else (table.dst, table.src)
    df = table.df.where(table.src.isNotNull() & table.dst.isNotNull())
    df = df.select(table.id.alias(id_), F.lit(table.type).alias(type_), table.src.alias(src), table.dst.alias(dst), a.alias(start), b.alias(end), *_select(table, shape, names), *_select(node, ends, own))
    rel = Rel(id_, type_, src, dst, tuple((k, names[k], t) for k, t in shape.items()), ends_of([table], "src"), ends_of([table], "dst"))
    return df, rel, start, end, Node(start if side == "from" else end, node.labels, tuple((k, own[k], t) for k, t in ends.items()))


def towards(tables: list[RelTable], direction: str, labels: tuple[str, ...]) -> list[RelTable]:
    """The tables that can lead to a node of these labels."""
    if direction == "both" or not labels:
        return tables
    side = "dst_labels" if direction == "out" else "src_labels"
    return [t for t in tables if getattr(t, side) is None or set(labels) <= getattr(t, side)]


def ends_imply(tables: list[RelTable], direction: str, side: str, labels: tuple[str, ...]) -> bool:
    """Whether every relationship's end (side: from or to) is known to have the labels."""
    ends = {"out": ("src", "dst"), "in": ("dst", "src"), "both": ("both", "both")}[direction][0 if side == "from" else 1]
    sides = [s for t in tables for s in ((t.src_labels,) if ends == "src" else (t.dst_labels,) if ends == "dst" else (t.src_labels, t.dst_labels))]
    return not labels or all(s is not None and set(labels) <= s for s in sides)


def level_tables(tables: list[RelTable], labels: frozenset[str] | None, direction: str, hops: int) -> list[list[RelTable]]:
    """For each hop the tables that a walk from nodes of known labels can use; ends where no table goes on.

    Without known labels, every table may be used at every hop.
    """
    if labels is None or any(t.src_labels is None or t.dst_labels is None for t in tables):
        return [tables] * hops
    out: list[list[RelTable]] = []
    at = {labels}
    for _ in range(hops):
        steps = [(t, a, b) for t in tables for a, b in ((t.src_labels, t.dst_labels), (t.dst_labels, t.src_labels)) if direction == "both" or (direction == "out") == (a is t.src_labels)]
        taken = [(t, b) for t, a, b in steps if a in at]
        if not taken:
            break
        out.append(list({id(t): t for t, _ in taken}.values()))
        at = {b for _, b in taken}
    return out


def reached(tables: list[list[RelTable]], labels: frozenset[str] | None) -> frozenset[frozenset[str]] | None:
    """The sets of labels of all nodes on walks that start at known labels and use these tables hop by hop; None if tables do not tell."""
    ends = [ends_of(level, side) for level in tables for side in ("src", "dst")]
    return None if labels is None or any(e is None for e in ends) else frozenset([labels]).union(*ends)
