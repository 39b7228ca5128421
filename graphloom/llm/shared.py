"""Session helpers that the operators share: work folders, sizes, keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many bytes (by a measured count) may be broadcast.
BROADCAST_BYTES = 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where it is unset and all runs on this machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir names a folder that the driver and all executors share")
        where = _LOCAL.get("dir")
        if where is None:
            where = _LOCAL["dir"] = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, where, True)
    if spark._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


_LOCAL: dict[str, str] = {}


#: While a table is written: delete the plan's shuffle files when it has run, and hand Python small batches of texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: lineage is cut, any executor may be lost.

    Its shuffle files go when it is written: nothing reads them again.

    options: Parquet's own, for the writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    with _writing(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].paths.append((path, out))
    return out


class Scratch:
    """The tables that are stored inside a `with`; at its end those go that are not kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def keep(self, *tables: DataFrame) -> None:
        """Tables, as `stored` gave them, that a result still reads."""
        self.kept += tables

    def __enter__(self) -> "Scratch":
        _SCRATCH.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _SCRATCH.remove(self)
        for path, table in self.paths:
            if kind is None and any(table is k for k in self.kept):
                if _SCRATCH:
                    _SCRATCH[-1].paths.append((path, table))
            else:
                drop(self.spark, path)


_SCRATCH: list[Scratch] = []


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Estimates beyond this are measured instead: without file sizes Catalyst assumes the worst.
DOUBTFUL = 1 << 44


def estimated_bytes(df: DataFrame, text_col: str) -> int:
    """About how many bytes df's texts take in files: Catalyst's figure, from file sizes alone, or else half of what a pass over the texts counts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > DOUBTFUL:
        size = (df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0) // 2
    return size
