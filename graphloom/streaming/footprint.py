"""What of a graph a query can depend on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cypher import syntax as S

#: Functions that see of an entity no more than its identity, labels or type.
IDENTITY = ("id", "labels", "type", "count")


@dataclass(frozen=True)
class Footprint:
    """Labels, types and keys; None: any."""

    labels: frozenset[str] | None
    types: frozenset[str] | None
    keys: frozenset[str] | None

    def concerns(self) -> Column:
        """Rows of a change log that may change the result."""
        node = F.col("entity") == "node"
        label = F.lit(True) if self.labels is None else F.arrays_overlap("kinds", F.array(*[F.lit(x) for x in sorted(self.labels)]).cast("array<string>"))
        type_ = F.lit(True) if self.types is None else F.arrays_overlap("kinds", F.array(*[F.lit(x) for x in sorted(self.types)]).cast("array<string>"))
        key = F.lit(True) if self.keys is None else F.arrays_overlap("keys", F.array(*[F.lit(x) for x in sorted(self.keys)]).cast("array<string>"))
        return F.coalesce(F.when(node, label & (F.col("structural") | key)).otherwise(type_), F.lit(False))


def footprint(q: S.Query) -> Footprint:
    labels: set[str] | None = set()
    types: set[str] | None = set()
    keys: set[str] | None = set()
    pattern_vars = {x.var for x in S.parts_of(q) if isinstance(x, (S.NodePattern, S.RelPattern)) and x.var}

    def any_key() -> None:
        nonlocal keys
        keys = None

    known_labels: dict[str, bool] = {}
    for x in S.parts_of(q):
        if isinstance(x, S.NodePattern) and x.var:
            known_labels[x.var] = known_labels.get(x.var, False) or bool(x.labels)
    for x in S.parts_of(q):
        match x:
            case S.NodePattern(var, own, props):
                if own:
                    if labels is not None:
                        labels |= set(own)
                elif var is None or not known_labels[var]:
                    labels = None
                if props and keys is not None:
                    keys |= {k for k, _ in props.items}
            case S.RelPattern(_, own, _, _, _, _, props):
                if not own:
                    types = None
                elif types is not None:
                    types |= set(own)
                if props and keys is not None:
                    keys |= {k for k, _ in props.items}
            case S.Part(_, _, path, shortest) if path or shortest:
                labels = None
            case S.HasLabels(_, own):
                if labels is not None:
                    labels |= set(own)
            case S.Prop(_, key):
                if keys is not None:
                    keys.add(key)
            case S.Index() | S.Slice() | S.Comprehension() | S.Quantifier():
                any_key()
            case S.Projection(star=True):
                any_key()

    def bare(e, shielded: bool) -> None:
        """Entities that are used whole."""
        match e:
            case S.Var(name):
                if name in pattern_vars and not shielded:
                    any_key()
            case S.Prop(of):
                bare(of, isinstance(of, S.Var))
            case S.HasLabels(of):
                bare(of, isinstance(of, S.Var))
            case S.Call(name, args):
                for a in args:
                    bare(a, isinstance(a, S.Var) and name.lower() in IDENTITY)
            case tuple():
                for y in e:
                    bare(y, False)
            case _ if hasattr(e, "__dataclass_fields__"):
                for y in vars(e).values():
                    bare(y, False)

    bare(q.arms, False)
    return Footprint(frozenset(labels) if labels is not None else None, frozenset(types) if types is not None else None, frozenset(keys) if keys is not None else None)


def anchored(q: S.Query) -> bool:
    """Whether matches can be kept up to date one by one: MATCH, WHERE and RETURN of fixed length, without aggregates, DISTINCT, order or paging."""
    if len(q.arms) != 1 or len(q.arms[0]) != 2:
        return False
    match q.arms[0]:
        case (S.Match(parts, where, False), S.Return(p)):
            plain = not (p.distinct or p.order or p.skip is not None or p.limit is not None or p.star)
            fixed = all(not x.shortest and not x.path and all(not r.variable for r in x.rels) for x in parts)
            calls = [x for x in S.parts_of((where, p)) if isinstance(x, S.Call)]
            steady = not any(S.is_aggregate(x) or x.name.lower() in ("rand", "timestamp", "startnode", "endnode") for x in calls)
            return plain and fixed and steady
    return False
