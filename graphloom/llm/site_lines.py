"""Line dedup by site-relative frequency (operator 3).

A line is boilerplate on a host if the pages of the host that contain it are
more than a given share of all its pages.  Lines travel as 128-bit hashes, once
a page, and are summed on the map side, so neither a hot host nor a hot line
makes a hot task; lines seen on fewer than `min_pages` pages go before anything
is joined.  A host cannot have more than (lines a page) / `max_ratio` such
lines, so they fit beside each page as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, Scratch, stored, unused

#: White space at a line's ends does not tell lines apart.
BLANKS = " \t\r\f\v"


def _line_hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate_lines(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 5) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines; hosts without any are left out.  A null host is a host."""
    rows = pages.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS))))
    seen = rows.select("host", F.explode(F.filter(lines, lambda x: x != "")).alias("line")).select("host", _line_hash(F.col("line")).alias("h"))
    often = stored(seen.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages), "lines")
    totals = stored(rows.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages).withColumnRenamed("host", "of"), "hosts")
    if totals.count() * 100 <= BROADCAST_BYTES:
        totals = F.broadcast(totals)
    over = often.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("pages") * F.lit(max_ratio))
    return over.groupBy("host").agg(F.collect_list("h").alias("lines"))


def drop_boilerplate(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.1, min_pages: int = 5, counts: bool = True) -> DataFrame:
    """`pages` with the boilerplate lines of its host taken out of each text.

    max_ratio: a line goes if more than this share of the host's pages contain
    it, on at least min_pages pages (a host of a few pages has no boilerplate).
    Each row is a page, repeated or not; a line counts once a page.  Blank
    lines never go.  A null text stays null and contains no line but counts as
    a page; a text that loses all lines is empty.  With `counts`, n_lines and
    n_dropped follow the columns of `pages` (columns of those names are
    replaced); all other columns stay, whatever their names.
    """
    host, gone = unused(pages, "host_"), unused(pages, "lines_")
    with Scratch(pages.sparkSession) as scratch:
        over = stored(boilerplate_lines(pages, host_col=host_col, text_col=text_col, max_ratio=max_ratio, min_pages=min_pages).toDF(host, gone), "boilerplate")
        scratch.keep(over)
    size = over.agg(F.sum(60 + 24 * F.size(gone))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        over = F.broadcast(over)
    joined = pages.join(over, F.col(host_col).cast("string").eqNullSafe(F.col(host)), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    kept = F.filter(lines, lambda x: (F.trim(x, F.lit(BLANKS)) == "") | ~F.array_contains(F.col(gone), _line_hash(F.trim(x, F.lit(BLANKS)))))
    text = F.when(F.col(gone).isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias(c) if c == text_col else F.col(c) for c in pages.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
        left = F.when(F.col(gone).isNull() | F.col(text_col).isNull(), n).otherwise(F.size(kept).cast("long"))
        out += [F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"), F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n - left).cast("long").alias("n_dropped")]
    return joined.select(*out)


def lines_report(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, for each document; its source is its host."""
    return drop_boilerplate(documents.select("doc_id", "source", "text"), **options).select("doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_text"))


#: The same for DuckDB.
SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, source, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS t FROM l),
c AS (SELECT source, t, count(DISTINCT doc_id) AS n FROM k WHERE t <> '' GROUP BY source, t),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
o AS (SELECT c.source, c.t FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND pages >= 5 AND n > pages * 0.1::DOUBLE),
m AS (SELECT k.doc_id, count(*) AS n_lines, count(o.t) AS n_dropped, coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE o.t IS NULL), '') AS kept_text
      FROM k LEFT JOIN o ON k.source IS NOT DISTINCT FROM o.source AND k.t = o.t GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE m.kept_text END AS kept_text
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
"""
