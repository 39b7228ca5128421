"""Benchmark decontamination by winnowing (operator 6).

Every text becomes a row of k-gram hashes; of each `window - k + 1` consecutive
ones the smallest is its fingerprint, so two texts that share `window` words
share the fingerprint of that window.  Training fingerprints are matched with
those of the benchmark; each match is then extended to the full window and
compared word by word, so that no hash decides alone.

The benchmark is a stated query set.  If its texts take no more than
`block_bytes`, its fingerprints and windows are broadcast and all documents meet
them in one pass without a shuffle.  Beyond that, the distinct fingerprints of
each document are joined with those of the benchmark; a bitmap of fixed size
clears most of them before they travel.  Documents with a common fingerprint
show the windows that have it, and these are joined with the benchmark's by
their words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import BLOCK
from .shared import stored, unused
from .text import ALNUM, FOLD, Words, buffers, grams, release, sliding_min, spans, union_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CHUNK = (1 << 20) - 2  # tables of powers have a power of two of entries
LOWER = bytes(FOLD.tolist())


class Block:
    """The fingerprints and windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, str]], k: int, window: int):
        self.k, self.window = k, window
        found: dict[bytes, set[str]] = {}
        for item, text in items:
            words = WORD.findall(text.encode().translate(LOWER))
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                found.setdefault(b" ".join(words[i : i + size]), set()).add(item)
        self.items = sorted({i for s in found.values() for i in s})
        number = {x: i for i, x in enumerate(self.items)}
        self.by_length: dict[int, tuple] = {}
        for n in sorted({w.count(b" ") + 1 for w in found}):
            texts = [w for w in found if w.count(b" ") + 1 == n]
            data = np.frombuffer(b" ".join(texts), np.uint8)
            sizes = np.array([len(t) + 1 for t in texts])
            words = Words(data, np.concatenate(([0], np.cumsum(sizes)[:-1], [len(data)])), ALNUM)
            h = words.hashes()
            full = grams(h, n)[::n]
            prints = sliding_min(grams(h, k), n - k + 1)[::n] if n == window else full
            order = np.argsort(full)
            self.by_length[n] = (
                np.unique(prints),
                full[order],
                [texts[i] for i in order],
                [np.array(sorted(number[x] for x in found[texts[i]]), np.int32) for i in order],
            )
        self.filters = {n: _bitmap(x[0]) for n, x in self.by_length.items()}


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, bool)
    bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return bits


def _known(hashes: np.ndarray, table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that are in the sorted table."""
    at = np.flatnonzero(bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    if not len(at) or not len(table):
        return at[:0]
    h = hashes[at]
    return at[table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h]


def matches(block: Block, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First word, length and items of every window of the block that occurs."""
    doc_end = np.repeat(words.docs[1:], words.counts())
    starts, lengths, items = [], [], []
    raw = words.data
    for n, (prints, full, texts, owners) in block.by_length.items():
        if len(hashes) < n:
            continue
        if n == block.window:
            found = sliding_min(grams(hashes, block.k), n - block.k + 1)
        else:
            found = grams(hashes, n)
        at = _known(found, prints, block.filters[n])
        at = at[at + n <= doc_end[at]]
        if not len(at):
            continue
        # Extend to the window: its own hash, then its words.
        h = hashes[at]
        with np.errstate(over="ignore"):
            from .text import BASE, mix

            for j in range(1, n):
                h = h * np.uint64(BASE) + hashes[at + j]
            h = mix(h)
        where = np.minimum(np.searchsorted(full, h), len(full) - 1)
        at, where = at[full[where] == h], where[full[where] == h]
        same = full[:-1] == full[1:]
        for i, w in zip(at.tolist(), where.tolist()):
            text = b" ".join(bytes(raw[s:e]) for s, e in zip(words.starts[i : i + n].tolist(), words.ends[i : i + n].tolist())).translate(LOWER)
            while texts[w] != text and w < len(same) and same[w]:
                w += 1
            if texts[w] == text:
                starts.append(i)
                lengths.append(n)
                items.append(owners[w])
    return np.array(starts, np.int64), np.array(lengths, np.int64), items


def _scan(block, k: int, window: int, keys: tuple[str, ...] = ("key",)):
    out = pa.schema([*((c, pa.int64()) for c in keys), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in spans(offsets, CHUNK):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                s, n, items = matches(b, words, words.hashes(fold=True))
                order = np.argsort(s, kind="stable")
                s, n = s[order], n[order]
                bounds = np.searchsorted(s, words.docs)
                starts, ends, names = [], [], []
                for d in range(j - i):
                    lo, hi = bounds[d], bounds[d + 1]
                    if lo == hi:
                        starts.append([])
                        ends.append([])
                        names.append([])
                        continue
                    x, y = union_of(s[lo:hi] - words.docs[d], (s + n)[lo:hi] - words.docs[d])
                    starts.append(x.tolist())
                    ends.append(y.tolist())
                    names.append(sorted({b.items[o] for q in order[lo:hi].tolist() for o in items[q].tolist()}))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in keys), pa.array(words.counts(), pa.int64()), pa.array(starts, out.field("starts").type), pa.array(ends, out.field("ends").type), pa.array(names, out.field("items").type)], schema=out)

    return run


OUT = "key long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _texts_of(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")


def small_block(items: DataFrame, k: int, window: int, block_bytes: int) -> Block | None:
    """All of the benchmark, if its measured texts are no more than block_bytes."""
    if (items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0) > block_bytes:
        return None
    return Block([(r["item"], r["text"]) for r in items.collect()], k, window)


#: Bits of the bitmap of the benchmark's fingerprints: 16 MB, however large the benchmark is.
BITMAP_BITS = 27


def fingerprints(hashes: np.ndarray, n: int, k: int) -> np.ndarray:
    """The smallest k-gram hash of each window of n words; of shorter ones, their own."""
    return sliding_min(grams(hashes, k), n - k + 1) if n >= k else grams(hashes, n)


def _shown(words: Words, low: np.ndarray, at: np.ndarray, n: int) -> list[str]:
    """The words of the windows that start at `at`, joined by blanks; low: the texts' bytes, lower-cased."""
    s, e = words.starts, words.ends
    return [b" ".join(low[a:b].tobytes() for a, b in zip(s[i : i + n].tolist(), e[i : i + n].tolist())).decode() for i in at.tolist()]


def _windows(k: int, window: int):
    """The windows of benchmark items."""
    out = pa.schema([("n", pa.int32()), ("print", pa.int64()), ("words", pa.string()), ("item", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in spans(offsets, CHUNK):
                low = FOLD[data[offsets[i] : offsets[j]]]
                words = Words(low, offsets[i : j + 1] - offsets[i], ALNUM)
                h, counts = words.hashes(), words.counts()
                for d in range(j - i):
                    n = int(min(window, counts[d]))
                    if not n:
                        continue
                    own = fingerprints(h[words.docs[d] : words.docs[d + 1]], n, k).view(np.int64)
                    for a in range(0, len(own), 1 << 14):
                        p = own[a : a + (1 << 14)]
                        shown = _shown(words, low, words.docs[d] + np.arange(a, a + len(p)), n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), n, np.int32)), pa.array(p), pa.array(shown), pa.array([batch.column("item")[i + d].as_py()] * len(p), pa.string())], schema=out)

    return run


def _prints(k: int, lengths: list[int], bitmap):
    """For each document its number of words (n is null), and its distinct fingerprints that the bitmap knows."""
    out = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = bitmap.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows = batch.column("row").to_numpy()
            for i, j in spans(offsets, CHUNK):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                h, doc = words.hashes(fold=True), words.doc_of()
                yield pa.RecordBatch.from_arrays([pa.array(rows[i:j]), pa.nulls(j - i, pa.int32()), pa.array(words.counts().astype(np.int64))], schema=out)
                for n in lengths:
                    f = fingerprints(h, n, k)
                    if not len(f):
                        continue
                    place = f & np.uint64((1 << BITMAP_BITS) - 1)
                    at = np.flatnonzero(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    at = at[doc[at] == doc[at + n - 1]]
                    order = np.lexsort((f[at], doc[at]))
                    f, d = f[at][order], doc[at][order]
                    new = np.ones(len(f), bool)
                    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[i:j][d[new]]), pa.array(np.full(int(new.sum()), n, np.int32)), pa.array(f[new].view(np.int64))], schema=out)

    return run


def _extend(k: int):
    """The windows of each document that have one of its matched fingerprints."""
    out = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("start", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows, matched = batch.column("row").to_numpy(), batch.column("matched").to_pylist()
            for d in range(batch.num_rows):
                low = FOLD[data[offsets[d] : offsets[d + 1]]]
                words = Words(low, np.array([0, len(low)]), ALNUM)
                h = words.hashes()
                for n in sorted({m["n"] for m in matched[d]}):
                    f = fingerprints(h, n, k)
                    at = np.flatnonzero(np.isin(f, np.array([m["print"] for m in matched[d] if m["n"] == n], np.int64).view(np.uint64)))
                    for a in range(0, len(at), 1 << 14):
                        part = at[a : a + (1 << 14)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), rows[d])), pa.array(np.full(len(part), n, np.int32)), pa.array(part), pa.array(_shown(words, low, part, n), pa.string())], schema=out)

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Disjoint, ordered ranges of each row's windows."""
    for batch in batches:
        starts, ends = [], []
        for windows in batch.column("windows").to_pylist():
            w = np.array([(x["start"], x["start"] + x["n"]) for x in windows], np.int64)
            w = w[np.argsort(w[:, 0], kind="stable")]
            s, e = union_of(w[:, 0], w[:, 1])
            starts.append(s.tolist())
            ends.append(e.tolist())
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(starts, kind), pa.array(ends, kind)], names=["row", "starts", "ends"])


def _joined(docs: DataFrame, items: DataFrame, k: int, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, n_words), (row, starts, ends) and (row, items) of written documents (row, key, text), by a join of fingerprints; the latter two of contaminated rows alone."""
    spark = docs.sparkSession
    windows = stored(items.mapInArrow(_windows(k, window), "n int, print long, words string, item string").distinct(), "windows")
    prints = windows.select("n", "print").distinct()
    place = F.col("print").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bitmap = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    blocks = windows.select(F.floor(place / BLOCK).alias("block"), (place % BLOCK).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    for r in blocks.toLocalIterator():
        bitmap[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    found = stored(docs.select("row", "text").mapInArrow(_prints(k, lengths, spark.sparkContext.broadcast(bitmap)), "row long, n int, print long"), "prints")
    matched = found.where("n is not null").join(prints, ["n", "print"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("n", "print")).alias("matched"))
    shown = stored(docs.select("row", "text").join(matched, "row").mapInArrow(_extend(k), "row long, n int, start long, words string"), "shown")
    hits = shown.join(windows.select("words").distinct(), "words", "left_semi")
    ranges = hits.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("windows")).mapInArrow(_unite, "row long, starts array<long>, ends array<long>")
    names = shown.select("row", "words").distinct().join(windows.select("words", "item"), "words").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.where("n is null").select("row", F.col("print").alias("n_words")), ranges, names


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", k: int = 5, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """One row (key, n_words, starts, ends, items) for each row of `documents`.

    starts and ends are the disjoint, ordered word ranges that occurrences of
    benchmark windows cover; items the sorted ids whose windows occur.  A null
    or empty text has no words and no range.  A benchmark row with a null id
    or text, or without words, matches nothing; an empty benchmark leaves all
    documents clean.  Equal benchmark rows count once, by their id.  Rows of
    `documents` that repeat an id, or have none, are reported each on their
    own.  A benchmark of more than block_bytes is joined, not broadcast, with
    the same result; ids and texts are then written once with a number for
    each row.  Other columns are not read.
    """
    if not 1 <= k <= window:
        raise ValueError("k lies between 1 and window")
    docs = documents.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    items = _texts_of(benchmark, item_col, "text")
    if (block := small_block(items, k, window, block_bytes)) is not None:
        return docs.mapInArrow(_scan(documents.sparkSession.sparkContext.broadcast(block), k, window), OUT)
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "documents")
    words, ranges, names = _joined(docs, items, k, window)
    out = docs.select("row", "key").join(words, "row").join(ranges, "row", "left").join(names, "row", "left")
    none = F.array().cast("array<long>")
    return out.select("key", "n_words", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of the contract: one row per document."""
    found = find_contamination(documents, benchmark, **options)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", k: int = 5, window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """`documents` without the rows that hold a benchmark window; columns unchanged.

    Ids are not read: each row, repeated or without an id, is judged by its own
    text.  A null or empty text holds no window and stays.
    """
    sc = documents.sparkSession.sparkContext
    items = _texts_of(benchmark, item_col, "text")
    if (block := small_block(items, k, window, block_bytes)) is not None:
        return documents.mapInArrow(_clean(sc.broadcast(block), text_col), documents.schema)
    row = unused(documents, "row")
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "documents")
    _, ranges, _ = _joined(numbered.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")), items, k, window)
    return numbered.join(ranges.select(F.col("row").alias(row)), row, "left_anti").select(*documents.columns)


def _clean(block, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(text_col))
            keep = np.ones(batch.num_rows, bool)
            for i, j in spans(offsets, CHUNK):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                s, _, _ = matches(block.value, words, words.hashes(fold=True))
                keep[i + np.searchsorted(words.docs, s, "right") - 1] = False
            yield batch.filter(pa.array(keep))
        release()

    return run


def brute_force(documents: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """The contract in plain Python, for tests."""
    of: dict[tuple, set[str]] = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = WORD.findall(text.encode().translate(LOWER))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            of.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = sorted({len(x) for x in of})
    out = []
    for doc, text in documents:
        w = WORD.findall((text or "").encode().translate(LOWER))
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := of.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= own
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


#: The same for DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM s, unnest(range(1, len(w) - n + 2)) t(i)),
p AS (SELECT r, i, l.n, array_to_string(w[i:i + l.n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM q) l, unnest(range(1, len(w) - l.n + 2)) t(i)),
h AS (SELECT r, i, n, item FROM p JOIN q USING (k, n)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, i, n FROM h), unnest(range(i, i + n)) t(x) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN o USING (r)
"""
