"""Cutting lineage in the shared folder of the session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir names a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="graphloom-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        where = _own["dir"]
    return where


#: Deletes the shuffle files of a plan when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_at(df: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """df, computed once and kept as Parquet in a folder (the shared one by default), with its path."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/graphloom/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return path, spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder."""
    return cut_at(df)[1]


class Folder:
    """Small texts in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self) -> list[str]:
        fs, p = self._at()
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def read(self, name: str) -> str:
        fs, p = self._at(name)
        source = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new text, whole or not at all; false if the name is taken.

        The file system must refuse a rename onto a file that is there, as HDFS
        and local ones do; on a store that does not, let one writer write.
        """
        fs, part = self._at(f"{uuid.uuid4().hex}.part")
        out = fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        _, whole = self._at(name)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
        try:
            files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            files.rename(fs.makeQualified(part), fs.makeQualified(whole), options)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
                raise
            fs.delete(part, False)
            return False
        return True

    def remove(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)
