"""Distributed connected components with DataFrame operations alone.

Nodes are ordered by a hash.  Each round maps every node to the smallest of
itself and its neighbours and contracts the graph along that map.  A star of
any size goes in one round; in the order of a hash a chain loses about half of
its nodes in each, however its names are ordered, so rounds grow with the
logarithm of the longest path.  The maps, each smaller than the one before, are
put together from the last to the first.  Every table between rounds is written
to the shared folder; both sides of each join are plain exchanges, which
adaptive execution splits when one node has many edges.

Most of a chain's rounds are on few edges, and a round costs as many tasks as
there are partitions.  A caller whose nodes are longs may name a number of edges
that one task holds: when no more than those are left, they are counted and one
task joins them, instead of all further rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, stored


def _end(name: str) -> Column:
    return F.struct(F.xxhash64(name).alias("h"), F.col(name).alias("n"))


CLOSED = pa.schema([("node", pa.int64()), ("low", pa.int64())])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of all edges with the smallest that it reaches."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = find(p), find(q)
            parent[max(p, q)] = min(p, q)
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([find(x) for x in parent], pa.int64())], schema=CLOSED)


def rounds(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = 0) -> list[DataFrame]:
    """The map (x, low) of each round, of nodes as structs of a hash and the node; the last is one task's when at most task_edges are left."""
    some = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(_end(a).alias("p"), _end(b).alias("q"))
    live = stored(some.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "edges")
    maps: list[DataFrame] = []
    while n := live.count():
        if n <= task_edges:
            closed = live.select(F.col("u.n").alias("a"), F.col("v.n").alias("b")).coalesce(1).mapInArrow(_close, "node long, low long")
            maps.append(stored(closed.select(_end("node").alias("x"), _end("low").alias("low")), "low"))
            break
        both = live.select(F.col("u").alias("x"), F.col("v").alias("y")).union(live.select("v", "u"))
        low = stored(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low")), "low")
        moved = live.join(low.toDF("u", "lu"), "u").join(low.toDF("v", "lv"), "v").where("lu <> lv")
        live = stored(moved.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), "edges")
        maps.append(low)
    return maps


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = 0) -> DataFrame:
    """(node, component) for every node of an edge that is not a loop; component is its smallest node.

    Edges with a null end are ignored; loops and repeated edges change nothing.
    task_edges, for nodes that are longs: the edges that one task may hold.
    """
    with Scratch(edges.sparkSession) as scratch:
        maps = rounds(edges, a, b, task_edges)
        if not maps:
            return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).where(F.lit(False))
        found = maps.pop()
        while maps:
            step = found.toDF("low", "to")
            found = stored(maps.pop().join(step, "low", "left").select("x", F.coalesce("to", "low").alias("low")), "labels")
        names = found.groupBy("low").agg(F.min("x.n").alias("component"))
        out = stored(found.join(names, "low").select(F.col("x.n").alias("node"), "component"), "components")
        scratch.keep(out)
    return out
