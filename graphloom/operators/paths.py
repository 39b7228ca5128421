"""Variable-length expansion and shortest paths, level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scope import Node, Rel, fresh
from ..runtime import cut
from ..sources.graph import Graph, RelTable
from ..types import convert, spark_type
from .scan import level_tables, reached, scan_nodes, scan_rels

#: Hops of a variable length without an upper bound (a fixed limit of the language's engine).
MOST_HOPS = 100
#: Up to so many hops the joins stay one lazy plan; beyond, each level is written.
LAZY_HOPS = 4
#: The same for a search, whose levels are each read several times.
LAZY_SEARCH = 2


def expand_trails(spark: SparkSession, tables: list[RelTable], types: tuple[str, ...], direction: str, df: DataFrame, start: str, labels: frozenset[str] | None, low: int, high: int | None, keep_rels: bool) -> tuple[DataFrame, str, str | None, object]:
    """df with, for each trail of low..high relationships from column `start`, its end and (if kept) its relationships.

    A trail does not repeat a relationship.  labels: those of the start, if
    known; they tell which tables each hop can use, and how far any trail can
    go.  Returns the rows, the end's column, the relationships' column and
    their element type.
    """
    end, used, rels = fresh("end"), fresh("used"), fresh("rels")
    _, shape, _, _ = scan_rels(spark, tables, types, direction)
    item = shape.value().type
    levels = level_tables(tables, labels, direction, MOST_HOPS if high is None else high)
    lazy = len(levels) <= LAZY_HOPS
    base = df if lazy else cut(df.select(start).where(F.col(start).isNotNull()).distinct())
    key = "bigint" if len(tables) == 1 and not tables[0].type.startswith("@") else "struct<t:string,i:bigint>"
    level = base.withColumns({end: F.col(start), used: F.array().cast(f"array<{key}>")})
    if keep_rels:
        level = level.withColumn(rels, F.array().cast(f"array<{spark_type(item).simpleString()}>"))
    columns = level.columns
    found = [level] if low == 0 else []
    for hop, usable in enumerate(levels, 1):
        edges, rel, a, b = scan_rels(spark, usable, types, direction)
        mark: Column = F.col(rel.id) if key == "bigint" else F.struct(F.col(rel.type).alias("t"), F.col(rel.id).alias("i"))
        level = level.join(edges, (F.col(end) == F.col(a)) & ~F.array_contains(used, mark))
        steps = {end: F.col(b), used: F.array_append(used, mark)}
        if keep_rels:
            steps[rels] = F.array_append(rels, convert(rel.value(), item).col)
        level = level.withColumns(steps).select(*columns)
        if not lazy:
            level = cut(level)
            if level.isEmpty():
                break
        if hop >= low:
            found.append(level)
    out = found[0] if found else level.where(F.lit(False))
    for x in found[1:]:
        out = out.unionByName(x)
    if not lazy:
        out = df.join(out.withColumnRenamed(start, s := fresh("start")), F.col(start) == F.col(s))
    return out, end, rels if keep_rels else None, item


class _Search:
    """Breadth first from all nodes of one side at once: (s, cur, ids, rels) of the last level, with all nodes between.

    ids are the nodes of a path from s to cur, rels its relationships.  One path
    a node is kept, the one with the smallest relationships, unless `every`.
    """

    def __init__(self, spark, tables, types, direction: str, starts: DataFrame, levels: list[list[RelTable]], item, every: bool, keep):
        self.spark, self.types, self.direction, self.item, self.every, self.keep = spark, types, direction, item, every, keep
        self.levels = levels
        rels = F.array().cast(f"array<{spark_type(item).simpleString()}>")
        self.level = starts.select("s", F.col("s").alias("cur"), F.array("s").alias("ids"), rels.alias("rels"), F.array().cast("array<bigint>").alias("marks"))
        self.seen = self.level.select("s", "cur")
        self.depth = 0

    def step(self, live: DataFrame) -> None:
        """One hop on from the starts that are still asked for; loops are skipped, and a node that a start has reached is not reached again."""
        edges, rel, a, b = scan_rels(self.spark, self.levels[self.depth], self.types, self.direction)
        rows = self.level.join(live, "s", "left_semi").join(edges, (F.col("cur") == F.col(a)) & (F.col(a) != F.col(b)))
        rows = rows.withColumn("next", F.col(b)).join(self.seen.withColumnRenamed("cur", "next"), ["s", "next"], "left_anti")
        level = rows.select("s", F.col("next").alias("cur"), F.array_append("ids", F.col("next")).alias("ids"), F.array_append("rels", convert(rel.value(), self.item).col).alias("rels"), F.array_append("marks", F.col(rel.id)).alias("marks"))
        if not self.every:
            level = level.groupBy("s", "cur").agg(F.min_by(F.struct("ids", "rels", "marks"), "marks").alias("p")).select("s", "cur", "p.*")
        self.level = self.keep(level)
        self.seen = self.seen.unionByName(self.level.select("s", "cur").distinct())
        self.depth += 1


def shortest_paths(
    spark: SparkSession, graph: Graph, tables: list[RelTable], types: tuple[str, ...], direction: str, df: DataFrame, source: str, labels: frozenset[str] | None, target: str, to_labels: frozenset[str] | None, low: int, high: int | None, every: bool, keep_nodes: bool
) -> tuple[DataFrame, str, Node, Rel]:
    """df with the shortest paths between its two id columns, as struct(nodes, rels); rows without a path go.

    The search goes from all sources and, backwards, from all targets; at each
    hop the side with the smaller level goes on, and paths meet where the two
    last levels do.  (A search of a few hops goes from the sources alone, as one
    lazy plan.)  One path: one of the least length; every: all of them.  Loops
    are skipped; a node reaches itself only by the empty path, if low is 0.
    Nodes are joined to the paths that were found, from the tables that walks
    from the source can reach.
    """
    most = MOST_HOPS if high is None else high
    levels = level_tables(tables, labels, direction, most)
    lazy = len(levels) <= LAZY_SEARCH
    keep = (lambda x: x) if lazy else cut
    pairs = cut(df.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct())
    _, rel0, _, _ = scan_rels(spark, tables, types, direction)
    item = rel0.value().type
    nodes, node0 = scan_nodes(spark, graph, (), reached(levels, labels))
    ahead = _Search(spark, tables, types, direction, pairs.select("s").distinct(), levels, item, every, keep)
    back = {"out": "in", "in": "out", "both": "both"}[direction]
    behind = _Search(spark, tables, types, back, pairs.select(F.col("t").alias("s")).distinct(), level_tables(tables, to_labels, back, most), item, every, keep)
    found = [ahead.level.join(pairs.where("s = t").select("s"), "s").select("s", F.col("s").alias("t"), "ids", "rels")] if low == 0 else []
    left = keep(pairs.where("s <> t"))
    sizes = {} if lazy else {ahead: pairs.select("s").distinct().count(), behind: pairs.select("t").distinct().count()}
    while ahead.depth + behind.depth < most:
        if not lazy and left.isEmpty():
            break
        side = ahead if lazy else min(sizes, key=sizes.get)
        if side.depth >= len(side.levels):
            break
        side.step(left.select("s").distinct() if side is ahead else left.select(F.col("t").alias("s")).distinct())
        if not lazy:
            sizes[side] = side.level.count()
            if not sizes[side]:
                break
        if behind.depth:
            other = behind.level.select(F.col("s").alias("t"), "cur", F.expr("reverse(slice(ids, 1, size(ids) - 1))").alias("ids_"), F.reverse("rels").alias("rels_"))
            met = left.join(ahead.level, "s").join(other, ["t", "cur"])
            if not every:
                met = met.groupBy("s", "t").agg(F.min_by(F.struct("ids", "ids_", "rels", "rels_"), F.struct("ids", "ids_")).alias("p")).select("s", "t", "p.*")
            paths = keep(met.select("s", "t", F.concat("ids", "ids_").alias("ids"), F.concat("rels", "rels_").alias("rels")))
        else:
            paths = ahead.level.join(left.withColumnRenamed("t", "cur"), ["s", "cur"]).select("s", F.col("cur").alias("t"), "ids", "rels")
        found.append(paths)
        left = keep(left.join(paths.select("s", "t").distinct(), ["s", "t"], "left_anti"))
    out = reduce(DataFrame.unionByName, found) if found else ahead.level.where(F.lit(False)).select("s", F.col("cur").alias("t"), "ids", "rels")
    path, s, t = fresh("path"), fresh("s"), fresh("t")
    if keep_nodes:
        at = fresh("at")
        out = cut(out.withColumn(at, F.monotonically_increasing_id()))
        each = out.select(at, F.posexplode("ids").alias("place", "node")).join(nodes, F.col("node") == F.col(node0.id))
        whole = each.groupBy(at).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", node0.value().col.alias("n")))), lambda x: x["n"]).alias("nodes"))
        out = out.join(whole, at)
    else:
        out = out.withColumn("nodes", F.transform("ids", lambda x: F.struct(x.alias("id"))))
    out = out.select(F.col("s").alias(s), F.col("t").alias(t), F.struct("nodes", "rels").alias(path))
    return df.join(out, (F.col(source) == F.col(s)) & (F.col(target) == F.col(t))), path, node0, rel0
