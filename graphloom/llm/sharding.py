"""Sharding by extendible hashing (operator 2), in DataFrame operations alone.

A directory is indexed by the leading bits of a key's hash.  A bucket that
exceeds the byte limit, and no other, splits on its next bit, until every shard
fits.  Bytes are summed once by cells of so many bits as the whole needs; the
directory is the coarsest cut of that tree that fits, and only rows of cells
that are still too large are looked at again with more bits.  Rows that no bit of
the hash tells apart go on splitting on the bits of a number of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, stored, unused

#: Bits of the hash: the first 15 hex digits of MD5.
BITS = 60
#: Bits of a row's number.
ROW_BITS = 63
#: More bits that are tried at once, and their sum at the first look.
STEP, MOST_FIRST = 8, 18


def key_hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits: int, width: int) -> Column:
    return F.shiftright(h, width - bits)


def _bits(cell: Column, bits: int) -> Column:
    return F.call_function("lpad", F.bin(cell), F.lit(bits), F.lit("0"))


def _cut(cells: DataFrame, known: int, bits: int, limit: int) -> DataFrame:
    """(base, cell, depth, bytes, rows): for each cell of `bits` bits the coarsest prefix in its base, deeper than `known` bits, that fits; null depth where none does."""
    up = cells.select("base", "cell", "bytes", "rows", F.explode(F.sequence(F.lit(known), F.lit(bits))).alias("depth"))
    up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(bits) - F.col("depth")).cast("int")))
    sums = up.groupBy("base", "depth", "prefix").agg(F.sum("bytes").alias("all_bytes"), F.sum("rows").alias("all_rows"))
    fit = up.join(sums, ["base", "depth", "prefix"]).where(F.col("all_bytes") <= limit)
    best = fit.groupBy("base", "cell").agg(F.min(F.struct("depth", "all_bytes", "all_rows")).alias("best"))
    return cells.join(best, ["base", "cell"], "left").select("base", "cell", "best.depth", F.col("best.all_bytes").alias("shard_bytes"), F.col("best.all_rows").alias("shard_rows"))


def _split(rows: DataFrame, width: int, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """(key, row, base, shard, shard_bytes, shard_rows) of the rows (key, row, base, h, bytes) of each base, cut by h's `width` bits, and the rows that no prefix fits, if any."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(MOST_FIRST, width, max(1, math.ceil(math.log2(max(2, total / limit))) + 3))
    known, done = 0, []
    while True:
        cells = stored(rows.groupBy("base", _prefix(F.col("h"), bits, width).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "cells")
        cut = stored(_cut(cells, known, bits, limit), "directory")
        small = F.broadcast(cut) if cut.count() * 64 <= BROADCAST_BYTES else cut
        found = rows.withColumn("cell", _prefix(F.col("h"), bits, width)).join(small, ["base", "cell"])
        name = _bits(F.col("cell"), bits).substr(F.lit(1), F.col("depth"))
        done.append(found.where("depth is not null").select("key", "row", "base", name.alias("shard"), "shard_bytes", "shard_rows"))
        if cut.where("depth is null").isEmpty():
            return done, None
        rows = stored(found.where("depth is null").select("key", "row", "base", "h", "bytes"), "keys")
        if bits == width:
            return done, rows
        known, bits = bits, min(width, bits + STEP)


def _assign(rows: DataFrame, limit: int) -> DataFrame:
    """(key, row, shard, shard_bytes, shard_rows) of written rows (key, row, bytes)."""
    columns = "key", "row", "shard", "shard_bytes", "shard_rows"
    done, alike = _split(rows.select("key", "row", F.lit(0).cast("long").alias("base"), key_hash(F.col("key")).alias("h"), "bytes"), BITS, limit)
    done = [d.select(*columns) for d in done]
    if alike is not None:
        # The row's number tells them apart, its last bit first: neighbours part at once.
        number = F.reverse(_bits(F.col("row"), ROW_BITS))
        alike = alike.select("key", "row", F.col("h").alias("base"), F.conv(number, 2, 10).cast("long").alias("h"), "bytes")
        base = _bits(F.col("base"), BITS)
        long = F.col("bytes") > limit
        done.append(alike.where(long).select("key", "row", F.concat(base, F.lit("."), _bits(F.col("h"), ROW_BITS)).alias("shard"), F.col("bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows")))
        parts, _ = _split(alike.where(~long), ROW_BITS, limit)
        done += [d.withColumn("shard", F.concat(base, F.lit("."), "shard")).select(*columns) for d in parts]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _bytes_of(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")


def shard(documents: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 64 << 20) -> DataFrame:
    """One row (key, shard, shard_bytes, shard_rows) for each row of `documents`.

    shard is the bits of the directory entry, as a string of 0 and 1 (empty if
    all fits in one); a shard's UTF-8 bytes of text never exceed limit_bytes,
    except for a row that is longer by itself.  A null text has no bytes, a
    null key hashes as the empty one.  Rows whose keys' hashes agree in all
    bits cannot be told apart by any bit; if they exceed the limit, they are
    split in the same way on the bits of a number that each row is given, which
    follow a dot; a row that is longer than the limit has such a sub-shard of
    its own.  Other columns are not read.
    """
    rows = documents.select(F.col(key_col).alias("key"), F.monotonically_increasing_id().alias("row"), _bytes_of(text_col).alias("bytes"))
    return _assign(stored(rows, "keys"), limit_bytes).drop("row")


def write_shards(documents: DataFrame, path: str, *, key_col: str = "doc_id", text_col: str = "text", limit_bytes: int = 64 << 20) -> DataFrame:
    """Write `documents` under path, one folder `shard=s...` for each shard, and return what was written.

    Every row is written once, also if its key is null or repeats or its text
    is null; without rows the folder holds an empty table.  If `documents` has
    a column shard, the folders' column is shard_ (with more underscores if
    need be) and the table keeps its own.
    """
    number, folder = unused(documents, "row_"), unused(documents, "shard")
    numbered = stored(documents.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = stored(numbered.select(F.col(key_col).alias("key"), F.col(number).alias("row"), _bytes_of(text_col).alias("bytes")), "keys")
    of = _assign(rows, limit_bytes).select(F.col("row").alias(number), F.concat(F.lit("s"), "shard").alias(folder))
    out = numbered.join(of, number).drop(number)
    out.repartition(folder).write.partitionBy(folder).parquet(path)
    return documents.sparkSession.read.schema(out.schema).parquet(path)


def shard_report(documents: DataFrame, **options) -> DataFrame:
    """doc_id, shard, shard_bytes and shard_rows of every document."""
    return shard(documents, **options).withColumnRenamed("key", "doc_id")


#: The same for DuckDB, to 24 bits, with any limit.
LIMITED_SQL = r"""
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS b FROM documents),
d AS (SELECT unnest(range(0, 25)) AS depth),
s AS (SELECT depth, h >> (60 - depth)::INTEGER AS prefix, sum(b)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM r, d GROUP BY ALL),
f AS (SELECT doc_id, h, min(depth) AS depth FROM r, d JOIN s USING (depth) WHERE s.prefix = h >> (60 - depth)::INTEGER AND shard_bytes <= @LIMIT GROUP BY ALL)
SELECT f.doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(s.prefix), depth::INTEGER, '0') END AS shard, shard_bytes, shard_rows
FROM f JOIN s USING (depth) WHERE s.prefix = f.h >> (60 - depth)::INTEGER
"""
SQL = LIMITED_SQL.replace("@LIMIT", str(64 << 20))
