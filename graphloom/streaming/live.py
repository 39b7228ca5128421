"""A query whose result is followed: batches of added and removed rows.

The first batch is the whole result.  After a commit, the change log tells
whether the query can be concerned at all.  If it is, a query that keeps its
matches apart (see `anchored`) replaces those that touch changed nodes: the
query is run from each node variable over the changed nodes only, and the batch
is the difference of these matches and the stale ones.  Matches are kept as
tables, each with the nodes that have changed since it was written, so a batch
writes what it changes; now and then the tables are merged.  Any other query is
run again in full, and the batch is the difference of the two results as
multisets.

With a checkpoint folder, what is kept outlives the session, and a query that
is followed again goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cypher import syntax as S
from ..errors import ResultLimitError, StreamQueryError
from ..plans.compiler import Rows
from ..plans.scope import Node, Rel
from ..plans.writes import Writer
from ..runtime import Folder, cut, cut_at
from ..types import Value, common, convert, type_of
from .footprint import anchored, footprint

#: With more changed nodes than this the whole query is run again (a fixed limit of the language's engine).
MOST_DIRTY = 4096


@dataclass(frozen=True)
class Changes:
    added: DataFrame
    removed: DataFrame
    initial: bool
    version: int


#: Tables of matches beyond which they are merged.
MOST_PARTS = 8


class LiveQuery:
    """Follows a read query.  `poll` gives the next batch; `start` does so in the background, by Structured Streaming over the store's versions.

    error: what ended it, if an evaluation failed; closed: whether it was closed.
    """

    def __init__(self, session, q: S.Query, params: Mapping[str, object], max_rows: int, checkpoint: str | None = None):
        if q.writes:
            raise StreamQueryError("a live query only reads")
        if any(isinstance(c, S.Schema) for a in q.arms for c in a):
            raise StreamQueryError("a schema command cannot be followed")
        self.session, self.query, self.params, self.max_rows = session, q, params, max_rows
        self.footprint, self.anchored = footprint(q), anchored(q)
        self.mode = "none"
        self.version: int | None = None
        self.error: Exception | None = None
        self.closed = False
        self._count = 0
        self._rows: str | None = None  # the result, of a query that is run in full
        self._parts: list[str] = []  # tables of matches, and the nodes that changed after each but the last
        self._later: list[list[int]] = []
        self._stream = None
        self._on_end: Callable[[Exception | None], object] | None = None
        self._folder = checkpoint
        self._states = Folder(session.spark, checkpoint) if checkpoint else None
        if self._states is not None and (there := self._saved()):
            state = json.loads(self._states.read(f"state-{max(there)}.json"))
            if state["query"] != repr(q) or state["store"] != session.store.path:
                raise StreamQueryError("the checkpoint is of another query or store")
            self.version, self._count, self._rows, self._parts, self._later = state["version"], state["count"], state["rows"], state["parts"], state["later"]

    # What is kept.

    def _saved(self) -> list[int]:
        return [int(n[6:-5]) for n in self._states.names() if n.startswith("state-") and n.endswith(".json")]

    def _save(self) -> None:
        if self._states is None:
            return
        there = self._saved()
        state = {"query": repr(self.query), "store": self.session.store.path, "version": self.version, "count": self._count, "rows": self._rows, "parts": self._parts, "later": self._later}
        self._states.create(f"state-{max(there, default=0) + 1}.json", json.dumps(state))
        for n in there:
            self._states.remove(f"state-{n}.json")

    def _kept(self, df: DataFrame) -> str:
        return cut_at(df, self._folder)[0]

    def _read(self, path: str) -> DataFrame:
        return self.session.spark.read.parquet(path)

    def _matches(self) -> DataFrame:
        """All matches that are good."""
        parts = []
        for i, path in enumerate(self._parts):
            df = self._read(path)
            stale = sorted({x for later in self._later[i:] for x in later})
            parts.append(df.where(~_touched(df, stale)) if stale else df)
        return reduce(lambda a, b: DataFrame.unionByName(*_aligned(a, b)), parts)

    # Batches.

    def poll(self) -> Changes | None:
        """What changed since the last batch; None if nothing did.  The first batch comes even when empty."""
        if self.closed or self.error is not None:
            raise StreamQueryError("the live query has ended") from self.error
        try:
            return self._poll()
        except Exception as e:
            self.error = e
            raise

    def _poll(self) -> Changes | None:
        store = self.session.store
        latest = store.latest()
        if self.version is None:
            rows = self._evaluate(store.snapshot(latest))
            self.version, self.mode = latest, "initial"
            self._save()
            return Changes(rows, rows.where(F.lit(False)), True, latest)
        if latest == self.version:
            return None
        log = store.changed_since(self.version, latest).where(self.footprint.concerns())
        if log.limit(1).isEmpty():
            self.version, self.mode = latest, "skipped"
            self._save()
            return None
        snapshot = store.snapshot(latest)
        dirty = self._dirty(log) if self.anchored else None
        if dirty is not None:
            stale, fresh = self._refresh(snapshot, dirty)
        else:
            stale = self._shown(self._matches()) if self.anchored else self._read(self._rows)
            fresh = self._evaluate(snapshot)
        added, removed = cut(_minus(fresh, stale)), cut(_minus(stale, fresh))
        if dirty is not None:
            self._count += added.count() - removed.count()
            if self._count > self.max_rows:
                raise ResultLimitError(f"the result has more than {self.max_rows} rows")
        self.version = latest
        self._save()
        if added.isEmpty() and removed.isEmpty():
            return None
        return Changes(added, removed, False, latest)

    def _evaluate(self, snapshot) -> DataFrame:
        self.mode = "full"
        if self.anchored:
            self._parts, self._later = [self._kept(self._seeded(snapshot, None, None))], []
            rows = self._shown(self._matches())
        else:
            w = Writer(self.session.spark, snapshot, self.params, self.session.strict)
            self._rows = self._kept(w.returned(w.arm(self.query.arms[0])) if len(self.query.arms) == 1 else w.query(self.query))
            rows = self._read(self._rows)
        self._count = rows.limit(self.max_rows + 1).count()
        if self._count > self.max_rows:
            raise ResultLimitError(f"the result has more than {self.max_rows} rows")
        return rows

    def _dirty(self, log: DataFrame) -> list[int] | None:
        """Ids of the changed nodes and of the ends of changed relationships, or None for too many."""
        ids = log.select(F.explode(F.when(F.col("entity") == "node", F.array("id")).otherwise(F.array("src", "dst"))).alias("id")).distinct()
        found = [r["id"] for r in ids.limit(MOST_DIRTY + 1).collect()]
        return found if len(found) <= MOST_DIRTY else None

    def _refresh(self, snapshot, dirty: list[int]) -> tuple[DataFrame, DataFrame]:
        """The result's rows of matches that touch the dirty nodes, as they were and as they are."""
        self.mode = "anchored"
        matches = self._matches()
        nodes = [c for c in matches.columns if c.startswith("n#")]
        stale = cut(matches.where(_touched(matches, dirty)))
        fresh = reduce(DataFrame.unionByName, [self._seeded(snapshot, c, dirty).select(*[f"`{x}`" for x in matches.columns]) for c in nodes])
        self._parts.append(self._kept(fresh.dropDuplicates([c for c in matches.columns if c.startswith(("n#", "r#"))])))
        self._later.append(dirty)
        now = self._read(self._parts[-1])
        if len(self._parts) > MOST_PARTS or sum(map(len, self._later)) > MOST_DIRTY:
            self._parts, self._later = [self._kept(self._matches())], []
        return self._shown(stale), self._shown(now)

    def _seeded(self, snapshot, seed: str | None, dirty: list[int] | None) -> DataFrame:
        """Matches as ids of their nodes and relationships with the returned columns; from changed nodes only, for the variable of `seed`."""
        match_, return_ = self.query.arms[0]
        names = iter(range(10**6))
        parts = tuple(replace(p, nodes=tuple(n if n.var else replace(n, var=f"~{next(names)}") for n in p.nodes), rels=tuple(r if r.var else replace(r, var=f"~{next(names)}") for r in p.rels)) for p in match_.parts)
        w = Writer(self.session.spark, snapshot, self.params, self.session.strict)
        w.uses = w._uses((replace(match_, parts=parts), return_))
        rows = w.match(parts, match_.where, Rows(None, {}))
        df = rows.df
        if seed is not None:
            df = df.where(F.col(rows.scope[seed[2:]].id).isin(dirty))
        ids = [F.col(b.id).alias(f"n#{n}") for n, b in rows.scope.items() if isinstance(b, Node)]
        ids += [c for n, b in rows.scope.items() if isinstance(b, Rel) for c in (F.col(b.id).alias(f"r#{n}"),)]
        out = [w.x.value(i.expr, rows.scope).col.alias(f"v#{i.name}") for i in return_.projection.items]
        return df.select(*ids, *out)

    @staticmethod
    def _shown(matches: DataFrame) -> DataFrame:
        return matches.select(*[F.col(f"`{c}`").alias(c[2:]) for c in matches.columns if c.startswith("v#")])

    # In the background.

    def start(self, on_change: Callable[[Changes], object], trigger_seconds: float = 1.0, on_end: Callable[[Exception | None], object] | None = None):
        """Call on_change with the first batch and then with each other one, as commits arrive; on_end with what ended it, None for `close`."""
        self._on_end = on_end
        if self.version is None:
            on_change(self.poll())
        log = self.session.spark.readStream.schema("version long").option("pathGlobFilter", "*.json").json(self.session.store.versions.path)

        def step(_: DataFrame, __: int) -> None:
            if self.closed or self.error is not None:
                return
            try:
                if (c := self.poll()) is not None:
                    on_change(c)
            except Exception as e:
                self.error = self.error or e
                self._ended()
                raise

        self._stream = log.writeStream.foreachBatch(step).trigger(processingTime=f"{trigger_seconds} seconds").start()
        return self._stream

    def _ended(self) -> None:
        end, self._on_end = self._on_end, None
        if end is not None:
            end(self.error)

    def close(self) -> None:
        """Stop following; with a checkpoint, another live query can go on from here."""
        self.closed = True
        if self._stream is not None:
            self._stream.stop()
            self._stream = None
        self._ended()


def _touched(matches: DataFrame, nodes: list[int]):
    """Whether a match has one of the nodes."""
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isin(nodes) for c in matches.columns if c.startswith("n#")])


def _aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the columns of a, in types that hold both; a property may have got a wider one since."""
    if a.schema == b.schema:
        return a, b
    types = {f.name: common(type_of(f.dataType), type_of(b.schema[f.name].dataType)) for f in a.schema.fields}

    def wide(df: DataFrame) -> DataFrame:
        return df.select(*[convert(Value(F.col(f"`{n}`"), type_of(df.schema[n].dataType)), t).col.alias(n) for n, t in types.items()])

    return wide(a), wide(b)


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """a without b, as multisets."""
    a, b = _aligned(a, b)
    return a.exceptAll(b)
