"""What variables stand for while a query is compiled."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Type, Value, null, struct_of

_numbers = itertools.count()


def fresh(hint: str = "c") -> str:
    """A column name that no other plan uses."""
    return f"{hint}_{next(_numbers)}"


@dataclass(frozen=True)
class Node:
    """A node in columns of the current rows: id, labels (a column, or known), and one column a property."""

    id: str
    labels: str | tuple[str, ...] | None
    props: tuple[tuple[str, str, Type], ...] = ()

    kind = "node"

    def columns(self) -> list[str]:
        return [self.id, *([self.labels] if isinstance(self.labels, str) else []), *(c for _, c, _ in self.props)]

    def renamed(self, to: dict[str, str]) -> "Node":
        labels = to.get(self.labels, self.labels) if isinstance(self.labels, str) else self.labels
        return replace(self, id=to[self.id], labels=labels, props=tuple((k, to[c], t) for k, c, t in self.props))

    def labels_col(self) -> Column:
        if isinstance(self.labels, str):
            return F.col(self.labels)
        return F.when(F.col(self.id).isNotNull(), F.array(*[F.lit(x) for x in self.labels or ()]).cast("array<string>"))

    def prop(self, key: str) -> Value:
        for k, c, t in self.props:
            if k == key:
                return Value(F.col(c), t)
        return null()

    def value(self) -> Value:
        t = Type("node", fields=tuple((k, t) for k, _, t in self.props))
        props = struct_of(*[F.col(c).alias(k) for k, c, _ in self.props])
        return Value(F.when(F.col(self.id).isNotNull(), F.struct(F.col(self.id).alias("id"), self.labels_col().alias("labels"), props.alias("props"))), t)


@dataclass(frozen=True)
class Rel:
    id: str
    type: str  # a column
    src: str
    dst: str
    props: tuple[tuple[str, str, Type], ...] = ()
    src_labels: frozenset[frozenset[str]] | None = None  # what the tables say of all its ends; None if they do not
    dst_labels: frozenset[frozenset[str]] | None = None

    kind = "rel"

    def columns(self) -> list[str]:
        return [self.id, self.type, self.src, self.dst, *(c for _, c, _ in self.props)]

    def renamed(self, to: dict[str, str]) -> "Rel":
        return replace(self, id=to[self.id], type=to[self.type], src=to[self.src], dst=to[self.dst], props=tuple((k, to[c], t) for k, c, t in self.props))

    def prop(self, key: str) -> Value:
        return Node.prop(self, key)  # type: ignore[arg-type]

    def value(self) -> Value:
        t = Type("rel", fields=tuple((k, t) for k, _, t in self.props))
        props = struct_of(*[F.col(c).alias(k) for k, c, _ in self.props])
        whole = F.struct(*[F.col(c).alias(n) for n, c in (("id", self.id), ("type", self.type), ("src", self.src), ("dst", self.dst))], props.alias("props"))
        return Value(F.when(F.col(self.id).isNotNull(), whole), t)


@dataclass(frozen=True)
class Plain:
    """A value in one column."""

    col: str
    type: Type

    kind = "value"

    def columns(self) -> list[str]:
        return [self.col]

    def renamed(self, to: dict[str, str]) -> "Plain":
        return replace(self, col=to[self.col])

    def value(self) -> Value:
        return Value(F.col(self.col), self.type)


@dataclass(frozen=True)
class Bound:
    """A local variable of a comprehension."""

    of: Value

    def columns(self) -> list[str]:
        return []

    def value(self) -> Value:
        return self.of


Binding = Node | Rel | Plain | Bound
