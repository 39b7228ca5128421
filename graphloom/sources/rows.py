"""Rows in one canonical text form, for sinks and for telling results apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _sorted(c: Column, d: T.DataType) -> Column:
    """c with the fields of all structs in order of their names."""
    if isinstance(d, T.StructType):
        fields = [_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(d.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    if isinstance(d, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, d.elementType))
    return c


def canonical(df: DataFrame) -> DataFrame:
    """(row, hash): each row as JSON with its columns in order and all keys sorted, nulls kept, and a 64-bit hash of it."""
    cells = [_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    row = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    return df.select(row.alias("row")).withColumn("hash", F.xxhash64("row"))
