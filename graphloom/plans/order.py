"""The order in which the relationships of a cyclic pattern are joined.

Joined as written, a cycle may meet two far ends of it in pairs, as many as the
product of two tables, before the relationship between them is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, replace

from ..cypher import syntax as S
from ..operators.scan import rel_tables, towards
from ..sources.graph import Graph
from .scope import fresh

FLIP = {"out": "in", "in": "out", "both": "both"}


@dataclass(frozen=True)
class Hop:
    """A relationship between two named nodes; forth, back: whether at most one leaves each first, each second node."""

    a: str
    b: str
    rel: S.RelPattern
    forth: bool
    back: bool


class _Rows:
    """What is known of the rows after some hops: the bound nodes, and the nodes of which each is in one row at most.

    level: how many tables, besides one, the number of rows may be the product of.
    Nodes that are bound before are taken to be in one row each, unless a hop shows that one has many of another.
    """

    def __init__(self, bound: Collection[str], hops: list[Hop]):
        inner = [h for h in hops if h.a in bound and h.b in bound]
        many = {h.b for h in inner if h.forth and not h.back} | {h.a for h in inner if h.back and not h.forth}
        self.bound, self.keys, self.level = set(bound), set(bound) - many, 0

    def rank(self, h: Hop) -> int | None:
        """0: both ends are bound; 1: no row becomes more; 2: as many rows as relationships at most; 3: more; None: not adjacent."""
        if h.a in self.bound and h.b in self.bound:
            return 0
        if not {h.a, h.b} & self.bound:
            return None
        start, one = (h.a, h.forth) if h.a in self.bound else (h.b, h.back)
        return 1 if one else 2 if start in self.keys else 3

    def take(self, h: Hop) -> None:
        rank = self.rank(h)
        there, only = (h.b, h.back) if h.a in self.bound else (h.a, h.forth)
        start = h.a if there == h.b else h.b
        if rank is None:
            self.level += bool(self.bound)
            self.keys = set() if self.bound else {n for n, one in ((h.a, h.forth), (h.b, h.back)) if one}
        elif rank == 0:
            self.level -= 1
            self.keys = self.keys if h.forth or h.back else set()
        elif rank == 1:
            self.keys |= {there} if only and start in self.keys else set()
        else:
            self.level += rank == 3
            self.keys = {there} if only and rank == 2 else set()
        self.bound |= {h.a, h.b}


def _cost(hops: list[Hop], bound: Collection[str]) -> tuple[int, int]:
    rows, levels = _Rows(bound, hops), [0]
    for h in hops:
        rows.take(h)
        levels.append(rows.level)
    return max(levels), sum(levels)


def _greedy(hops: list[Hop], first: Hop, bound: Collection[str]) -> list[Hop]:
    """After the first always the adjacent hop that makes fewest rows, as written among equals."""
    rows, left, out = _Rows(bound, hops), list(hops), []
    while left:
        h = min(left, key=lambda h: 4 if (r := rows.rank(h)) is None else r) if out else first
        rows.take(h)
        left = [x for x in left if x is not h]
        out.append(h)
    return out


def taken(p: S.Part, bound: Collection[str]) -> Iterator[int]:
    """The relationships of a part in the order in which they are joined as written: from the first bound node to the right, then to the left."""
    at = next((i for i, n in enumerate(p.nodes) if n.var in bound), 0)
    yield from range(at, len(p.rels))
    yield from range(at - 1, -1, -1)


def bindings(parts: tuple[S.Part, ...], bound: Collection[str]) -> list[str]:
    """The variables of parts but shortest paths, in the order in which they are bound as written."""
    out = list(bound)
    for p in parts:
        if not p.shortest:
            at = next((i for i, n in enumerate(p.nodes) if n.var in out), 0)
            found = [p.nodes[at].var, *(x.var for i in taken(p, out) for x in (p.rels[i], p.nodes[i + 1 if i >= at else i]))]
            out += dict.fromkeys(n for n in found if n is not None and n not in out)
    return out


def _groups(parts: list[S.Part], bound: Collection[str]) -> list[list[S.Part]]:
    """Parts that share nodes; bound nodes are all in the same rows."""
    out: list[tuple[set[str], list[S.Part]]] = []
    for p in parts:
        names = {"" if n.var in bound else n.var for n in p.nodes}
        near = [g for g in out if g[0] & names]
        rest = [g for g in out if not g[0] & names]
        out = rest + [(names.union(*(g[0] for g in near)), [q for g in near for q in g[1]] + [p])]
    at = {id(p): i for i, p in enumerate(parts)}
    return sorted((sorted(g, key=lambda p: at[id(p)]) for _, g in out), key=lambda g: at[id(g[0])])


def _one(graph: Graph, r: S.RelPattern, start: S.NodePattern, end: S.NodePattern, direction: str) -> bool:
    """Whether at most one relationship leads from each node: the tables' rows are those of node tables, each of another."""
    if direction == "both":
        return False
    tables = towards(towards(rel_tables(graph, r.types), direction, end.labels), FLIP[direction], start.labels)
    own = [t.src_table if direction == "out" else t.dst_table for t in tables]
    return all(t is not None for t in own) and len({id(t) for t in own}) == len(own)


def _merged(parts: list[S.Part]) -> dict[str, S.NodePattern]:
    """One pattern a node, with the labels and properties of all its mentions."""
    out: dict[str, S.NodePattern] = {}
    for n in (n for p in parts for n in p.nodes):
        had = out.get(n.var, S.NodePattern(n.var, at=n.at))
        items = [i for m in (had.props, n.props) if m is not None for i in m.items]
        out[n.var] = replace(had, labels=tuple(dict.fromkeys((*had.labels, *n.labels))), props=S.MapOf(tuple(items)) if items else None)
    return out


def _planned(graph: Graph, parts: list[S.Part], bound: Collection[str]) -> list[S.Part]:
    """The parts as single relationships in a better order; as they are if there is no cycle or no such order."""
    nodes = _merged(parts)
    seen, written = set(bound), []
    for p in parts:
        for i in taken(p, seen):
            a, r, b = nodes[p.nodes[i].var], p.rels[i], nodes[p.nodes[i + 1].var]
            written.append(Hop(a.var, b.var, r, _one(graph, r, a, b, r.direction), _one(graph, r, b, a, FLIP[r.direction])))
        seen |= {n.var for n in p.nodes}
    held = [n for n in nodes if n in bound]
    if len(written) < len(nodes) - max(len(held) - 1, 0):
        return parts
    starts = [h for h in written if not held or {h.a, h.b} & set(held)]
    best = min((_greedy(written, h, held) for h in starts), key=lambda hops: _cost(hops, held))
    if _cost(best, held) >= _cost(written, held):
        return parts
    out: list[S.Part] = []
    for h in best:
        ends = tuple(nodes.pop(n, S.NodePattern(n)) for n in (h.a, h.b))
        out.append(S.Part(ends, (h.rel,)))
    return [S.Part((n,), ()) for n in nodes.values()] + out


def join_order(graph: Graph, parts: tuple[S.Part, ...], is_node: Callable[[str], bool]) -> tuple[S.Part, ...] | None:
    """Parts that match the same in fewer rows on the way; None to take them as written.

    Nodes without a name get one with '#'.  Walks and shortest paths come last, as written.
    """
    parts = tuple(replace(p, nodes=tuple(n if n.var else replace(n, var=fresh("#n")) for n in p.nodes)) for p in parts)
    fixed = [p for p in parts if not p.shortest and not any(r.variable for r in p.rels)]
    bound = {n.var for p in fixed for n in p.nodes if is_node(n.var)}
    groups = _groups(fixed, bound)
    planned = [_planned(graph, g, bound & {n.var for p in g for n in p.nodes}) for g in groups]
    if all(a is b for a, b in zip(groups, planned)):
        return None
    rest = [p for p in parts if p.shortest or any(r.variable for r in p.rels)]
    return tuple([p for g in planned for p in g] + rest)
