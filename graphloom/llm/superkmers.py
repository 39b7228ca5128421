"""Substring dedup by super-k-mer partitioning (operator 10).

A window is `k` consecutive words.  Its minimiser is the smallest hash among
the `m`-word grams inside it; consecutive windows with one minimiser travel
together, as one packed string, to the bucket of that minimiser.  All copies of
a window have the same minimiser, so each bucket counts its windows exactly on
its own: sort by hash, compare the words, take the smallest document.

Grams are ordered by hash, but those that a bounded sample finds in many
documents come after all others, so a window has a frequent minimiser only if
nothing else is in it.  The words beside a passage that a third of all documents
share thus go to buckets of their own.  Any sample gives the same result.

Before anything is sent, equal packed strings inside a task are compared: the
smallest document's goes to its bucket, the windows of the others are already
known to repeat.  A passage that a third of all documents share is sent once a
flush, not once a document.

The ranges found come back to their documents, where the covered words go.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, estimated_bytes, stored
from .text import NOT_SPACE, U64, Words, _powers, buffers, equal_ranges, gather, grams, mix, release, runs, sliding_min, spans, union_of

CHUNK = (1 << 20) - 2  # tables of powers have a power of two of entries
FLUSH = 24 << 20
NO_ID = (1 << 63) - 1
_ZSTD = "zstd"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any types as one compressed string; numbers go byte plane by byte plane."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        if raw.dtype.itemsize > 1:
            raw = raw.view(np.uint8).reshape(-1, raw.dtype.itemsize).T
        parts.append(raw.tobytes())
    raw = b"".join(parts)
    head = struct.pack(f"<{len(arrays) + 1}q", len(raw), *(len(p) for p in parts))
    return head + pa.Codec(_ZSTD, compression_level=3).compress(raw, asbytes=True)


def _unpack(blob: bytes, types: list) -> list[np.ndarray]:
    head = struct.unpack_from(f"<{len(types) + 1}q", blob)
    raw = np.frombuffer(pa.Codec(_ZSTD).decompress(memoryview(blob)[8 * (len(types) + 1) :], decompressed_size=head[0]), np.uint8)
    out, at = [], 0
    for n, t in zip(head[1:], types):
        part, at, width = raw[at : at + n], at + n, np.dtype(t).itemsize
        out.append((part if width == 1 else np.ascontiguousarray(part.reshape(width, -1).T)).view(t).ravel())
    return out


def frequent_grams(documents: DataFrame, text_col: str, m: int, sample_bytes: int, share: float) -> np.ndarray:
    """The sorted hashes of m-word grams that more than `share` of the documents of a sample of about `sample_bytes` contain: at most 1 / share times the words of a mean document."""
    fraction = min(1.0, sample_bytes / max(1, estimated_bytes(documents, text_col)))
    texts = documents.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).sample(False, fraction, 17)
    out = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in spans(offsets, CHUNK):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
                g, doc = grams(words.hashes(), m), words.doc_of()
                inside = doc[: len(g)] == doc[m - 1 :] if len(g) else np.zeros(0, bool)
                once = np.unique(np.rec.fromarrays((g[inside], doc[: len(g)][inside])))  # a gram counts once a document
                found, n = np.unique(once["f0"], return_counts=True)
                n = np.concatenate(([j - i], n))  # number 0 counts documents
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((np.zeros(1, U64), found)).view(np.int64)), pa.array(n.astype(np.int64))], schema=out)

    with Scratch(documents.sparkSession):
        counts = stored(texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
        n = (counts.where("gram = 0").agg(F.max("n")).first()[0] or 0) * share
        return np.sort(np.array([r["gram"] for r in counts.where((F.col("gram") != 0) & (F.col("n") > max(n, 8))).toLocalIterator()], np.int64).view(U64))


def _ordered(g: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The grams' places in the order of minimisers: frequent ones last."""
    place = g >> U64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
        place |= (frequent[at] == g).astype(U64) << U64(63)
    return place


def _cut_chunk(words: Words, k: int, m: int, frequent: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """The super-k-mers of some documents: document, first word, windows, minimiser, hash of the words."""
    h = words.hashes()
    n = len(h) - k + 1
    if n <= 0:
        return None
    low = sliding_min(_ordered(grams(h, m), frequent), k - m + 1)
    doc = words.doc_of()
    inside = doc[:n] == doc[k - 1 :]
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1])
    new &= inside
    at = np.flatnonzero(new)
    if not len(at):
        return None
    cuts = np.flatnonzero(new | ~inside)
    nxt = np.searchsorted(cuts, at, "right")
    windows = np.where(nxt < len(cuts), cuts[np.minimum(nxt, len(cuts) - 1)], n) - at
    up, down = _powers(len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, U64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        whole = mix((sums[at + windows + k - 1] - sums[at]) * down[at])
    return doc[at], at, windows, low[at], whole


class _Held:
    """What a map task has cut and not yet sent."""

    def __init__(self):
        self.bytes, self.data, self.parts = 0, [], []

    def add(self, ids: np.ndarray, rows: np.ndarray, words: Words, k: int, m: int, frequent: np.ndarray) -> None:
        if (cut := _cut_chunk(words, k, m, frequent)) is not None:
            doc, at, windows, low, whole = cut
            begin = words.starts[at]
            size = words.ends[at + windows + k - 2] - begin
            self.parts.append((ids[doc], rows[doc], (at - words.docs[doc]).astype(np.uint32), windows.astype(np.uint32), low, whole, begin + self.bytes, size))
        self.data.append(words.data)
        self.bytes += len(words.data)

    def flush(self, buckets: int, k: int) -> Iterator[tuple[int, bytes]]:
        if not self.parts:
            self.__init__()
            return
        data = np.concatenate(self.data)
        ids, rows, start, windows, low, whole, begin, size = (np.concatenate(x) for x in zip(*self.parts))
        self.__init__()
        # Equal strings: only those of the smallest document go on.
        order = np.lexsort((ids, whole))
        bounds = runs(whole[order])
        count = np.diff(bounds)
        first = np.repeat(order[bounds[:-1]], count)
        later = order[(ids[order] > ids[first]) & (size[order] == size[first])]
        head = first[(ids[order] > ids[first]) & (size[order] == size[first])]
        same = equal_ranges(data, begin[later], begin[head], size[later])
        later = later[same]
        sent = np.ones(len(ids), bool)
        sent[later] = False
        bucket = (low % U64(buckets)).astype(np.int64)
        order = np.lexsort((ids, bucket))
        bounds = runs(bucket[order])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = order[lo:hi]
            s, d = own[sent[own]], own[~sent[own]]
            yield int(bucket[own[0]]), _pack(ids[s], rows[s], start[s], windows[s], size[s].astype(np.uint32), gather(data, begin[s], size[s]), ids[d], rows[d], start[d], windows[d])


TYPES = [np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.int64, np.int64, np.uint32, np.uint32]


def _cut(buckets: int, k: int, m: int, frequent):
    out = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def emit(held: _Held) -> Iterator[pa.RecordBatch]:
        for b, blob in held.flush(buckets, k):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            for i, j in spans(offsets, CHUNK):
                held.add(ids[i:j], rows[i:j], Words(data[offsets[i] : offsets[j]].copy(), offsets[i : j + 1] - offsets[i], NOT_SPACE), k, m, frequent.value)
                if held.bytes >= FLUSH:
                    yield from emit(held)
        yield from emit(held)
        release()

    return run


def _count_bucket(blobs: list[bytes], k: int) -> tuple[np.ndarray, ...]:
    """Ranges (id, row, first word, end) of the bucket's windows that start in a smaller document too."""
    cols = [np.concatenate(x) for x in zip(*(_unpack(b, TYPES) for b in blobs))]
    ids, rows, start, windows, size, data, d_ids, d_rows, d_start, d_windows = cols
    found = [(d_ids, d_rows, d_start.astype(np.int64), d_start.astype(np.int64) + d_windows + k - 1)]
    if len(ids):
        words = Words(data, np.concatenate(([0], np.cumsum(size.astype(np.int64)))), NOT_SPACE)
        h = grams(words.hashes(), k)
        at = np.arange(len(h))
        owner = words.doc_of()
        at = at[owner[at] == owner[at + k - 1]]
        h, own = h[at], owner[at]
        order = np.argsort(h, kind="stable")
        bounds = runs(h[order])
        order = order[np.repeat(np.diff(bounds) > 1, np.diff(bounds))]  # single windows repeat nowhere
        if len(order):
            order = order[np.lexsort((ids[own[order]], h[order]))]
            bounds = runs(h[order])
            first = np.repeat(order[bounds[:-1]], np.diff(bounds))
            begin, end = words.starts[at], words.ends[at + k - 1]
            less = ids[own[first]] < ids[own[order]]
            w, f = order[less], first[less]
            same = (end - begin)[w] == (end - begin)[f]
            same[same] = equal_ranges(data, begin[w[same]], begin[f[same]], (end - begin)[w[same]])
            keep = [w[same]]
            text = lambda x: tuple(bytes(data[s:e]) for s, e in zip(words.starts[at[x] : at[x] + k].tolist(), words.ends[at[x] : at[x] + k].tolist()))
            odd = set(h[w[~same]].tolist())  # other white space, or a hash that two windows share: compare the words themselves
            if odd:
                groups: dict[tuple, list[int]] = {}
                for x in order[np.isin(h[order], np.array(sorted(odd), U64))].tolist():
                    groups.setdefault(text(x), []).append(x)
                keep.append(np.array([x for g in groups.values() for x in g if ids[own[x]] > min(ids[own[y]] for y in g[:1])], np.int64))
                keep[0] = keep[0][~np.isin(h[keep[0]], np.array(sorted(odd), U64))]
            hit = np.sort(np.concatenate(keep))
            o = own[hit]
            s = start[o].astype(np.int64) + at[hit] - words.docs[o]
            found.append((ids[o], rows[o], s, s + k))
    ids, rows, s, e = (np.concatenate(x) for x in zip(*found))
    # Unite the ranges of a document.
    order = np.lexsort((s, rows, ids))
    ids, rows, s, e = ids[order], rows[order], s[order], e[order]
    joined = np.zeros(len(s), bool)
    if len(s) > 1:
        joined[1:] = (ids[1:] == ids[:-1]) & (rows[1:] == rows[:-1])
    group = np.cumsum(~joined) - 1
    span = int(e.max()) + 1 if len(e) else 1
    us, ue = union_of(s + group * span, e + group * span)
    head = np.searchsorted(s + group * span, us, "left")
    return ids[head], rows[head], us - group[head] * span, ue - group[head] * span


def _count(k: int):
    out = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])

    def done(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if blobs:
            ids, rows, s, e = _count_bucket(blobs, k)
            for i in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], t.type) for x, t in zip((ids, rows, s, e), out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != now:
                    yield from done(held)
                    held, now = [], b
                held.append(blob)
        yield from done(held)
        del held
        release()

    return run


def _cover():
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            ranges = batch.column("ranges")
            for i, j in spans(offsets, CHUNK):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE)
                removed = np.zeros(len(words) + 1, np.int64)
                part = ranges.slice(i, j - i)
                flat = part.flatten()
                if len(flat):
                    counts = pa.compute.fill_null(pa.compute.list_value_length(part), 0).to_numpy()
                    base = np.repeat(words.docs[:-1], counts)
                    np.add.at(removed, flat.field("s").to_numpy() + base, 1)
                    np.add.at(removed, flat.field("e").to_numpy() + base, -1)
                kept = np.flatnonzero(np.cumsum(removed)[:-1] == 0)
                bounds = np.searchsorted(kept, words.docs)
                size = words.ends[kept] - words.starts[kept] + 1
                last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
                size[last] -= 1
                ends = np.cumsum(size)
                text = gather(np.concatenate((words.data, [np.uint8(0x20)])), words.starts[kept], size)
                spaced = np.ones(len(kept), bool)
                spaced[last] = False
                text[ends[spaced] - 1] = 0x20
                at = np.concatenate(([0], ends))[bounds]
                strings = pa.StringArray.from_buffers(j - i, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(words.counts(), pa.int64()), pa.array(words.counts() - np.diff(bounds), pa.int64()), strings], schema=out)

    return run


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 13, m: int = 3, bucket_bytes: int = 8 << 20, sample_bytes: int = 8 << 20) -> DataFrame:
    """One row (id, n_words, n_removed, kept_text) for each row of `documents`.

    sample_bytes bounds the texts that tell which grams are frequent, and so
    where windows are counted, never what is counted.

    A word goes if a window that covers it also starts in a document with a
    smaller id.  A null or empty text has no words and keeps the empty text; a
    text shorter than `k` words loses nothing.  A null id counts as larger than
    every id; rows of one id, repeated or not, never remove each other's
    words.  Other columns are not read.
    """
    if not 1 <= m <= k:
        raise ValueError("m lies between 1 and k")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(
        F.col(id_col).cast("long").alias("true_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("row"),  # tells rows of one id, or of none, apart
        text.alias("text"),
    )
    buckets = max(64, estimated_bytes(documents, text_col) * 5 // bucket_bytes)
    frequent = documents.sparkSession.sparkContext.broadcast(frequent_grams(documents, text_col, m, sample_bytes, 1 / 256))
    sent = docs.select("id", "row", "text").mapInArrow(_cut(buckets, k, m, frequent), "bucket int, blob binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(k), "id long, row long, s long, e long")
    ranges = stored(found.groupBy("id", "row").agg(F.collect_set(F.struct("s", "e")).alias("ranges")), "repeats")
    joined = docs.join(ranges, ["id", "row"], "left").select(F.col("true_id").alias("id"), "text", "ranges")
    return joined.mapInArrow(_cover(), "id long, n_words long, n_removed long, kept_text string")


def repeats_report(documents: DataFrame, **options) -> DataFrame:
    """The digest of the contract: one row per document."""
    r = remove_repeats(documents, **options)
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same for DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT r, id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) t(i)),
f AS (SELECT k, min(id) AS low FROM n GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT r, p FROM (SELECT r, i FROM n JOIN f USING (k) WHERE low < id), unnest(range(i, i + 13)) t(p)),
a AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM a ANTI JOIN g USING (r, p) GROUP BY r),
c AS (SELECT r, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN c USING (r)
"""
