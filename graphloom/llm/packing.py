"""Cost-balanced packing (operator 9).

A sequence costs, for each piece in it, linear * n + quadratic * n**2 (attention
stays inside a piece).  Pieces of a full sequence stand alone.  What is left of
the documents is taken in blocks: as many sequences as the block's tokens fill,
the longest document first, each to the sequence of lowest cost that has room;
one that fits nowhere is cut into the largest gaps.  So at most one sequence of
a block is not full.

Tokens come from a public tokenizer file.  White space ends a pre-token, so
white space with the word after it is tokenised once and then looked up, on
whole batches, by a hash and then byte by byte; texts with other white space
than ASCII, or with a unit whose hash another one has, go to the tokenizer
whole.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import NOT_SPACE, U64, Words, buffers, equal_ranges, gather, hash_ranges, release, spans

CHUNK = 1 << 20
#: Documents whose units cannot be told by ASCII white space, and the tokenizer's own control string.
ODD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xe1\xa0\x8e|\xef\xbb\xbf|<\|endoftext\|>")

_BLANK = frozenset(b" \t\n\x0b\x0c\r")


class _Column:
    """An array that grows."""

    def __init__(self, kind):
        self.all, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.all):
            more = np.zeros(max(len(self.all) * 3 // 2, self.n + len(x)), self.all.dtype)
            more[: self.n] = self.all[: self.n]
            self.all = more
        self.all[self.n : self.n + len(x)] = x
        self.n += len(x)


class Tokens:
    """Token ids of whole texts, from a tokenizer file.

    Units are kept by the order of their hashes, with what is known of each in
    the order in which they came.  When there are too many, those go that have
    not been met again.
    """

    LIMIT, LIMIT_BYTES = 900_000, 24 << 20  # of the units that are kept

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Bytes of each token: a byte-level token has one letter a byte.
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slot = np.zeros(0, U64), np.zeros(0, np.int32)
        self.at, self.length, self.begin, self.size = (_Column(np.int32) for _ in range(4))
        self.ids, self.bytes, self.again = _Column(np.uint32), _Column(np.uint8), _Column(bool)

    def _thin(self) -> None:
        """Keep the units that have been met again, if they are few enough."""
        met = np.flatnonzero(self.again.all[self.slot])
        hashes, slot, old = self.hashes[met], self.slot[met], (self.at, self.length, self.begin, self.size, self.ids, self.bytes)
        self._clear()
        if 2 * len(met) > self.LIMIT:
            return
        at, length, begin, size = (c.all[slot].astype(np.int64) for c in old[:4])
        self.hashes = hashes
        self._append(at, length, begin, size, gather(old[4].all, at, length), gather(old[5].all, begin, size))
        self.slot = np.arange(len(hashes), dtype=np.int32)

    def _append(self, at, length, begin, size, ids, raw) -> None:
        """Units whose ids and bytes come one after the other."""
        self.at.add(self.ids.n + np.cumsum(length) - length)
        self.length.add(length)
        self.begin.add(self.bytes.n + np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(ids)
        self.bytes.add(raw)
        self.again.add(np.zeros(len(length), bool))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([len(x) for x in found], np.int64), np.array([y for x in found for y in x], np.uint32)

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units.  Those that begin with white space and end without are tokenised as one text: no token spans two."""
        size = np.array([len(u) for u in units], np.int64)
        joins = np.array([u[0] in _BLANK and u[-1] not in _BLANK for u in units])
        together = [b"".join(units[i] for i in part.tolist()).decode() for part in np.array_split(np.flatnonzero(joins), max(1, int(joins.sum()) // 4000))]
        ids = np.array([x for e in self.tokenizer.encode_batch_fast(together, add_special_tokens=False) for x in e.ids], np.uint32)
        ends = np.cumsum(self.width[ids])
        if (ends[-1] if len(ends) else 0) != size[joins].sum():  # no byte-level tokenizer: each unit by itself
            return self._encode([u.decode() for u in units])
        if joins.all():
            return np.diff(np.searchsorted(ends, np.cumsum(size), "right"), prepend=0), ids
        length = np.zeros(len(units), np.int64)
        length[joins] = np.diff(np.searchsorted(ends, np.cumsum(size[joins]), "right"), prepend=0)
        length[~joins], others = self._encode([units[i].decode() for i in np.flatnonzero(~joins).tolist()])
        which = np.repeat(joins, length)
        out = np.zeros(len(which), np.uint32)
        out[which], out[~which] = ids, others
        return length, out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and n + 1 offsets into them."""
        n = len(offsets) - 1
        raw = data.tobytes()
        odd = np.zeros(n, bool)
        for m in ODD.finditer(raw):
            d = int(np.searchsorted(offsets, m.start(), "right")) - 1
            odd[d] = True
        words = Words(data, offsets, NOT_SPACE)
        # Units: white space and the word after it; and what follows a text's last word.
        stops = np.sort(np.concatenate((words.ends, offsets[1:])))
        stops = stops[np.diff(stops, prepend=0) > 0]
        begins = np.concatenate(([0], stops[:-1]))
        owner = np.searchsorted(offsets, begins, "right") - 1
        h = hash_ranges(data, begins, stops)
        plain = ~odd[owner]
        while True:
            b, e, own = begins[plain], stops[plain], owner[plain]
            unique, first, inverse = np.unique(h[plain], return_index=True, return_inverse=True)
            # Units of one hash are the same bytes, here and among those that are kept.
            differs = np.flatnonzero(e - b != (e - b)[first][inverse])
            alike = np.flatnonzero(e - b == (e - b)[first][inverse])
            bad = np.append(differs, alike[~equal_ranges(data, b[alike], b[first[inverse[alike]]], (e - b)[alike])])
            if len(self.hashes) + len(unique) > self.LIMIT or self.bytes.n > self.LIMIT_BYTES:
                self._thin()
            where = np.searchsorted(self.hashes, unique)
            known = np.zeros(len(unique), bool)
            inside = where < len(self.hashes)
            known[inside] = self.hashes[where[inside]] == unique[inside]
            met, kept = np.flatnonzero(known), self.slot[where[known]]
            size = (e - b)[first[met]]
            same = size == self.size.all[kept]
            same[same] = equal_ranges(data, b[first[met[same]]], self.begin.all[kept[same]], size[same], self.bytes.all[: self.bytes.n])
            bad = np.concatenate((bad, np.flatnonzero(np.isin(inverse, met[~same]))))
            if not len(bad):
                break
            odd[own[bad]] = True
            plain = ~odd[owner]
        self.again.all[kept] = True
        if not known.all():
            new = np.flatnonzero(~known)
            at, size = b[first[new]], (e - b)[first[new]]
            length, ids = self._encode_units([raw[x : x + n] for x, n in zip(at.tolist(), size.tolist())])
            self.hashes = np.insert(self.hashes, where[new], unique[new])
            self.slot = np.insert(self.slot, where[new], np.arange(self.at.n, self.at.n + len(new), dtype=np.int32))
            self._append(at, length, at, size, ids, gather(data, at, size))
            where = np.searchsorted(self.hashes, unique)
        slot = self.slot[where][inverse]
        length, at = self.length.all[slot].astype(np.int64), self.at.all[slot].astype(np.int64)
        counts = np.bincount(own, weights=length, minlength=n).astype(np.int64) if len(own) else np.zeros(n, np.int64)
        rest = np.flatnonzero(odd)
        extra = {}
        for d in rest.tolist():
            _, extra[d] = self._encode([raw[offsets[d] : offsets[d + 1]].decode()])
            counts[d] = len(extra[d])
        out_at = np.concatenate(([0], np.cumsum(counts)))
        out = np.zeros(int(out_at[-1]), np.uint32)
        if len(own):
            ends = np.cumsum(length)
            index = np.arange(int(ends[-1])) + np.repeat(at - (ends - length), length)
            flat = self.ids.all[index]
            if len(rest):
                mask = np.ones(len(out), bool)
                for d in rest.tolist():
                    mask[out_at[d] : out_at[d + 1]] = False
                out[mask] = flat
            else:
                out = flat
        for d, ids in extra.items():
            out[out_at[d] : out_at[d + 1]] = ids
        return out, out_at


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The tokenizer of a file, which a worker process keeps for its next tasks."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, sequence) of pieces shorter than the capacity, in as few sequences as their tokens fill."""
    total = sum(lengths)
    room = [capacity] * -(-total // capacity)
    ready = [(0.0, s) for s in range(len(room))]  # by cost
    tight: list[tuple[int, float, int]] = []  # by room, with less than the piece at hand
    out = []
    for length, piece in sorted(((n, i) for i, n in enumerate(lengths) if n), key=lambda x: (-x[0], x[1])):
        start = 0
        while length:
            while tight and -tight[0][0] >= length:
                _, cost, s = heapq.heappop(tight)
                heapq.heappush(ready, (cost, s))
            while ready and room[ready[0][1]] < length:
                cost, s = heapq.heappop(ready)
                if room[s]:
                    heapq.heappush(tight, (-room[s], cost, s))
            if ready:
                cost, s = heapq.heappop(ready)
                n = length
            else:
                _, cost, s = heapq.heappop(tight)
                n = room[s]
            out.append((piece, start, n, s))
            room[s] -= n
            start += n
            length -= n
            if room[s]:
                heapq.heappush(ready, (cost + linear * n + quadratic * n * n, s))
    return out


OUT = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
OUT_SQL = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end_id: int, capacity: int, linear: float, quadratic: float, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        number = TaskContext.get().partitionId() << 40
        rests: list[tuple[int | None, int, np.ndarray, int]] = []
        held = 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), OUT)], schema=OUT)

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            filled: dict[int, int] = {}
            rows = []
            for p, start, n, s in balance([len(r[2]) for r in rests], capacity, linear, quadratic):
                id_, base, ids, total = rests[p]
                rows.append((id_, base + start, n, ids[start : start + n].tobytes(), total, number + s, filled.get(s, 0)))
                filled[s] = filled.get(s, 0) + n
            number += len(filled)
            rests.clear()
            held = 0
            if rows:
                yield batch(rows)

        for b in batches:
            data, offsets = buffers(b.column("text"))
            names = b.column("id").to_pylist()
            for i, j in spans(offsets, CHUNK):
                ids, at = tokens.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = []
                for d in range(j - i):
                    own = np.append(ids[at[d] : at[d + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(own) // capacity * capacity
                    for start in range(0, whole, capacity):
                        rows.append((names[i + d], start, capacity, own[start : start + capacity].tobytes(), len(own), number, 0))
                        number += 1
                    if whole < len(own):
                        rests.append((names[i + d], whole, own[whole:], len(own)))
                        held += len(own) - whole
                if rows:
                    yield batch(rows)
                if held >= block_tokens:
                    yield from settle()
        yield from settle()
        release()

    return run


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pack(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 512, block_tokens: int = 1 << 20) -> DataFrame:
    """One row (id, start, length, ids, doc_tokens, sequence_id, offset) for each piece of a document.

    ids are the piece's token ids as little-endian unsigned 32-bit numbers;
    start counts the document's ids before it, doc_tokens all of them with the
    end id that follows each text; offset counts those before it in its
    sequence.  Sequence ids are unique and never span tasks; they depend on
    how the input is partitioned.  A null or empty text is its end id alone.
    Each row is a document of its own, also if its id repeats or is null.
    Other columns are not read.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer or tokenizer_path(), end_id, capacity, linear, quadratic, block_tokens), OUT_SQL)


def packing_report(documents: DataFrame, **options) -> DataFrame:
    """The columns of the contract."""
    p = pack(documents, **options)
    return p.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
