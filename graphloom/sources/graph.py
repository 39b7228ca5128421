"""A property graph as views over DataFrames.

Each node table gives one label set, each relationship table one type; both map
properties to columns.  Node ids are unique in the whole graph: each table's
key plus an offset of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Type, type_of, widened

#: Keys of a node table are below this; the table's number is above it.
SPAN = 1 << 50


@dataclass(frozen=True)
class NodeTable:
    """df with columns for id and labels; labels is a tuple, or the name of an array column."""

    df: DataFrame
    id: Column
    labels: tuple[str, ...] | str
    props: tuple[tuple[str, Column, Type], ...]
    key: str | None = None


@dataclass(frozen=True)
class RelTable:
    """df with columns for id, source and target; type is a name, or a column's name behind '@'.

    src_table and dst_table: the node table whose very rows these are, if an
    end is that table's key; such an end has its properties at hand.
    """

    df: DataFrame
    id: Column
    type: str
    src: Column
    dst: Column
    src_labels: frozenset[str] | None
    dst_labels: frozenset[str] | None
    props: tuple[tuple[str, Column, Type], ...]
    src_table: NodeTable | None = None
    dst_table: NodeTable | None = None


@dataclass
class Graph:
    """Tables of nodes and relationships.  `add_nodes` and `add_rels` return the graph."""

    nodes: list[NodeTable] = field(default_factory=list)
    rels: list[RelTable] = field(default_factory=list)
    _offsets: dict[str, int] = field(default_factory=dict)

    def add_nodes(self, labels: str | tuple[str, ...], df: DataFrame, key: str | Column, props: dict[str, str | Column] | None = None) -> "Graph":
        """key: a column of non-negative integers, unique in df.  props: property to column; all columns by default."""
        labels = (labels,) if isinstance(labels, str) else tuple(labels)
        offset = len(self.nodes) * SPAN
        for name in labels:
            self._offsets.setdefault(name, offset)
        self.nodes.append(NodeTable(df, self._col(key).cast("long") + F.lit(offset), labels, self._props(df, props), key if isinstance(key, str) else None))
        return self

    def add_rels(self, kind: str, df: DataFrame, src: tuple[str, str | Column], dst: tuple[str, str | Column], key: str | Column, props: dict[str, str | Column] | None = None) -> "Graph":
        """src and dst: a label and the column of that table's key.  Every end must exist among the nodes."""

        def end(label: str, c: str | Column) -> Column:
            return self._col(c).cast("long") + F.lit(self._offsets[label])

        self.rels.append(RelTable(df, self._col(key).cast("long"), kind, end(*src), end(*dst), self._labels_of(src[0]), self._labels_of(dst[0]), self._props(df, props if props is not None else {}), self._rows_of(df, *src), self._rows_of(df, *dst)))
        return self

    def _rows_of(self, df: DataFrame, label: str, key: str | Column) -> NodeTable | None:
        t = next(t for t in self.nodes if label in t.labels)
        return t if t.df is df and isinstance(key, str) and key == t.key else None

    def _labels_of(self, label: str) -> frozenset[str]:
        return next(frozenset(t.labels) for t in self.nodes if label in t.labels)

    @staticmethod
    def _col(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c

    @classmethod
    def _props(cls, df: DataFrame, props: dict[str, str | Column] | None) -> tuple[tuple[str, Column, Type], ...]:
        if props is None:
            props = {c: c for c in df.columns}
        out = []
        for name, c in props.items():
            d = df.select(cls._col(c).alias("x")).schema["x"].dataType
            out.append((name, widened(cls._col(c), d), type_of(d)))
        return tuple(out)
