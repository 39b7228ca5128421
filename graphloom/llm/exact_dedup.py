"""Exact dedup with a log-structured merge index (operator 7), in DataFrame operations alone.

A memtable is a batch's entries, one a digest with the smallest id and the
number of rows, summed in its map tasks first.  It is flushed to a run: Parquet
in ranges of the digest, sorted, with row-group statistics, and beside it a
filter: a bitmap in blocks of 4 KB, one bit an entry at a hash of the digest.  A
batch is looked up in the older runs: the filter clears most digests that a run
does not hold, and only the rest are joined with the run.  Digests that a batch
repeats or finds in an older run are hits.  Compaction merges runs and keeps the
smallest identifier.

Rows without a hit are their own group and meet nothing more.  Each hit's texts
are compared byte by byte: the smallest and the largest text of a digest, taken
as partial aggregates as well, must be the same.  Digests for which they are not
are split by their texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, Scratch, stored


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digest_of(text: Column, bits: int = 256) -> Column:
    """The leading bits (a multiple of 8) of SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, bits // 8)


#: Bits of a block of a run's filter, and bits of the filter for each entry.
BLOCK, BITS_PER_ENTRY = 1 << 15, 32


@dataclass
class Run:
    """entries: (digest, low, rows), sorted in ranges of the digest; blocks: (block, bits) of the filter; size: the filter's bits."""

    entries: DataFrame
    blocks: DataFrame
    n_blocks: int
    size: int

    @staticmethod
    def _place(size: int) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(size))

    @classmethod
    def write(cls, entries: DataFrame) -> "Run":
        """A run of the entries, which are a written table."""
        n = entries.count()
        size = max(1, -(-n * BITS_PER_ENTRY // BLOCK)) * BLOCK
        run = stored(entries.repartitionByRange("digest").sortWithinPartitions("digest"), "run")
        place = cls._place(size)
        blocks = stored(run.select(F.floor(place / BLOCK).alias("block"), (place % BLOCK).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")), "filter")
        return cls(run, blocks, min(n, size // BLOCK), size)

    def may_hold(self, digests: DataFrame) -> DataFrame:
        """The digests that the filter lets through: all that the run holds and about one in thirty others."""
        blocks = F.broadcast(self.blocks) if self.n_blocks * (BLOCK // 8 + 16) <= BROADCAST_BYTES else self.blocks
        place = self._place(self.size)
        placed = digests.select("digest", F.floor(place / BLOCK).alias("block"), (place % BLOCK).alias("at"))
        byte = F.conv(F.hex(F.substr("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return placed.join(blocks, "block").where(F.expr("bits is not null")).where(F.call_function("shiftright", byte, (F.col("at") % 8).cast("int")) % 2 == 1).select("digest")

    def find(self, digests: DataFrame) -> DataFrame:
        """The entries of the digests that the run holds."""
        return self.entries.join(self.may_hold(digests), "digest", "left_semi")


class Index:
    """Sorted runs of (digest, low, rows), the newest last, and the digests that more than one row has had.

    `fanout` runs are compacted into one.  Runs, filters and hits are written
    tables in the shared folder: an index survives the loss of any executor.
    """

    def __init__(self, fanout: int = 4):
        self.runs: list[Run] = []
        self.repeated: list[DataFrame] = []
        self.fanout = fanout

    @staticmethod
    def _merged(entries: DataFrame) -> DataFrame:
        return entries.groupBy("digest").agg(F.min("low").alias("low"), F.sum("rows").alias("rows"))

    def find(self, digests: DataFrame) -> DataFrame:
        """(digest, low, rows) of those of the digests (a column digest) that the index holds: the look-up of a later batch."""
        return self._merged(_union([r.find(digests) for r in self.runs]))

    def flush(self, rows: DataFrame) -> None:
        """Add the (id, digest) rows of a batch as one run and note its hits; compact when there are `fanout`."""
        entries = stored(self._merged(rows.select("digest", F.col("id").alias("low"), F.lit(1).cast("long").alias("rows"))), "memtable")
        found = [r.find(entries).select("digest") for r in self.runs]
        self.repeated.append(stored(_union([entries.where("rows > 1").select("digest"), *found]).distinct(), "hits"))
        self.runs.append(Run.write(entries))
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> Run:
        """Merge all runs into one; the smallest identifier of a digest stays."""
        if len(self.runs) > 1:
            self.runs = [Run.write(stored(self._merged(_union([r.entries for r in self.runs])), "merged"))]
        return self.runs[0]

    def hits(self) -> DataFrame:
        """(digest, low, rows) of every digest that more than one row has."""
        return self.compact().entries.join(_union(self.repeated).distinct(), "digest", "left_semi")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def exact_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", memtables: int = 2, digest_bits: int = 256) -> DataFrame:
    """One row (id, keep_id, group_size, kept, digest) for each row of `documents`.

    Texts are equal if they are after normalisation; null counts as empty.
    keep_id is the smallest id of the equal texts, group_size their number of
    rows.  A null id is the smallest only if all are null.  Rows that repeat
    an id with an equal text are one document written twice: all carry the
    same keep_id, and all are marked kept if theirs is the smallest id.
    memtables: batches of rows (by a hash of the id) that are flushed as runs
    of their own, each looked up in those before it, and then compacted.
    digest is the whole SHA-256 in lower-case hex, whatever part of it
    (digest_bits) the index uses.  Other columns are not read.
    """
    text = normalised(F.col(text_col))
    sha = F.sha2(text, 256)
    rows = documents.select(F.col(id_col).cast("long").alias("id"), sha.alias("sha"), F.substring(F.unhex(sha), 1, digest_bits // 8).alias("digest"))
    rows = stored(rows, "digests")
    with Scratch(documents.sparkSession) as scratch:
        index = Index(fanout=memtables + 1)
        turn = F.pmod(F.xxhash64("id"), F.lit(memtables))
        for i in range(memtables):
            index.flush(rows.where(turn == i).select("id", "digest"))
        hits = stored(index.hits(), "groups")
        scratch.keep(hits)
    few = hits.count() * 64 <= BROADCAST_BYTES

    # Compare the bytes of hits.
    texts = documents.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("digest", digest_of(F.col("text"), digest_bits))
    compared = texts.join(F.broadcast(hits.select("digest")) if few else hits.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    clash = stored(compared.where(F.col("a") != F.col("b")).select("digest"), "clashes")
    found = rows.join(F.broadcast(hits) if few else hits, "digest", "left")
    low, n = F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("low")), F.coalesce("rows", F.lit(1))
    out = lambda df: df.select("id", low.alias("keep_id"), n.alias("group_size"), F.col("id").eqNullSafe(low).alias("kept"), F.col("sha").alias("digest"))
    if clash.isEmpty():
        return out(found)
    apart = texts.join(clash, "digest", "left_semi").withColumn("sha", F.sha2("text", 256))
    groups = stored(apart.groupBy("digest", "text").agg(F.min("id").alias("low"), F.count("*").alias("rows")), "texts")
    split = apart.join(groups, ["digest", "text"]).select("id", "sha", "digest", "low", "rows")
    return out(found.join(clash, "digest", "left_anti").select("id", "sha", "digest", "low", "rows").unionByName(split))


def exact_report(documents: DataFrame, **options) -> DataFrame:
    """The columns of the contract."""
    r = exact_duplicates(documents, **options)
    return r.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


#: The same for DuckDB.
SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
