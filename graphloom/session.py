"""The engine's front door: queries, transactions, import and live queries on one graph."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .cypher import analyse, parse
from .cypher import syntax as S
from .errors import ConflictError, ReadOnlyError, ResultLimitError, StreamQueryError, TransactionDone
from .plans.compiler import Compiler
from .plans.explain import explain
from .plans.writes import Writer
from .sources.graph import Graph
from .sources.store import Snapshot, Store


def _params(given: Mapping[str, object] | None) -> dict[str, object]:
    """Parameters by name; entities of earlier results stand for their properties, numbers of other libraries for Python's."""
    out = {}
    for name, v in (given or {}).items():
        if not isinstance(v, DataFrame) and hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
            v = v.item()
        out[name] = v
    return out


@dataclass(frozen=True)
class ImportResult:
    rows: int
    batches: int


class GraphSession:
    """Queries on a Graph (views over tables, read only) or on a Store (written by queries)."""

    def __init__(self, spark: SparkSession, source: Graph | Store | str | None = None, *, strict: bool = False):
        """source: a Graph, a Store, the path of one, or None for a new store.

        strict: arithmetic with null is an error of the query, not null.
        """
        self.spark, self.strict = spark, strict
        self.source = source if isinstance(source, (Graph, Store)) else Store(spark, source)

    @property
    def store(self) -> Store:
        if isinstance(self.source, Graph):
            raise ReadOnlyError("a graph over tables cannot be written")
        return self.source

    def _parsed(self, text: str) -> S.Query:
        q = parse(text)
        analyse(q)
        if q.stream:
            raise StreamQueryError("a STREAM query is for subscribe()")
        return q

    def query(self, text: str, params: Mapping[str, object] | None = None, *, max_rows: int | None = None) -> DataFrame:
        """The result of a query.  A write is committed before it returns; a conflict with another writer is tried again.

        max_rows: fail if a read has more rows.
        """
        q = self._parsed(text)
        if q.writes:
            return self.update(lambda tx: tx.query(text, params))
        if isinstance(self.source, Graph):
            df = Compiler(self.spark, self.source, _params(params), self.strict).query(q)
        else:
            df = _run(Writer(self.spark, self.source.snapshot(), _params(params), self.strict), q)
        return limited(df, max_rows)

    def explain(self, text: str, params: Mapping[str, object] | None = None, *, plan: bool = False) -> str:
        """The operators of a query, as a tree of text; with `plan`, also the plan that Spark runs for a read.

        A seek by an indexed key is a filter on a table that is laid out by the
        key: the plan shows it among the pushed filters of the scan.
        """
        q = parse(text)
        analyse(q)
        indexes = {} if isinstance(self.source, Graph) else self.source.snapshot().indexes
        tree = explain(q, set(indexes.values()))
        if not plan or q.writes:
            return tree
        df = self.query(text.removeprefix("STREAM "), params)
        return f"{tree}\n\n{df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), 'formatted')}"

    def update(self, change: Callable[["Transaction"], object], attempts: int = 10):
        """Run change(tx) and commit; if another writer came first, run it again on the new version."""
        for last in [*[False] * (attempts - 1), True]:
            tx = Transaction(self, self.store.snapshot(), True)
            try:
                out = change(tx)
                tx._commit()
                return out
            except ConflictError:
                if last:
                    raise
            finally:
                tx.done = True

    def view(self, read: Callable[["Transaction"], object]):
        """Run read(tx) on one version."""
        tx = Transaction(self, self.store.snapshot(), False)
        try:
            return read(tx)
        finally:
            tx.done = True

    def import_rows(self, text: str, rows: DataFrame | list, params: Mapping[str, object] | None = None, batch: int = 10_000) -> ImportResult:
        """Run a query that unwinds $rows, over a DataFrame at once or over a list in batches of one transaction each."""
        if isinstance(rows, DataFrame):
            n = rows.count()
            self.query(text, {**(params or {}), "rows": rows})
            return ImportResult(n, 1 if n else 0)
        for i in range(0, len(rows), batch):
            self.query(text, {**(params or {}), "rows": rows[i : i + batch]})
        return ImportResult(len(rows), math.ceil(len(rows) / batch))

    def subscribe(self, text: str, params: Mapping[str, object] | None = None, *, max_rows: int = 10_000, checkpoint: str | None = None):
        """A live query: its result now, and then what is added and removed.

        checkpoint: a folder for what it keeps; if there is something of the
        same query, it goes on from there, with what has changed since.
        """
        from .streaming.live import LiveQuery

        q = parse(text)
        analyse(q)
        return LiveQuery(self, q, _params(params), max_rows, checkpoint)


def limited(df: DataFrame, max_rows: int | None) -> DataFrame:
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ResultLimitError(f"the result has more than {max_rows} rows")
    return df


def _run(w: Writer, q: S.Query) -> DataFrame:
    if len(q.arms) == 1:
        rows = w.arm(q.arms[0])
        end = q.arms[0][-1]
        if not isinstance(end, (S.Return, S.Schema)) or isinstance(end, S.Schema) and not end.action.startswith("show"):
            return w.spark.createDataFrame([], "done boolean").drop("done")
        return w.returned(rows)
    return w.query(q)


class Transaction:
    """Queries on one version; writes are staged and seen by later queries of it."""

    def __init__(self, session: GraphSession, base: Snapshot, writable: bool):
        self.session, self.base, self.staged, self.writable, self.done = session, base, base, writable, False

    def query(self, text: str, params: Mapping[str, object] | None = None, *, max_rows: int | None = None) -> DataFrame:
        if self.done:
            raise TransactionDone("the transaction has ended")
        q = self.session._parsed(text)
        if q.writes and not self.writable:
            raise ReadOnlyError("a view only reads")
        w = Writer(self.session.spark, self.staged, _params(params), self.session.strict)
        df = _run(w, q)
        self.staged = w.staged
        return limited(df, max_rows)

    def _commit(self) -> None:
        if self.staged is not self.base:
            self.session.store.commit(self.base, self.staged)
