"""Exact Jaccard join on word shingles by PartEnum signatures (operator 8).

Sizes fall into bands whose ends differ by the threshold.  Two sets of Jaccard
similarity t or more differ in at most d = (1 - t) / (1 + t) * (|r| + |s|)
elements.  The feature domain is cut into parts, and each part into three
sub-parts.  In a part in which two sets differ in one element at most, they
agree on two of the three sub-parts.  So a set signs every part once for each
subset of two sub-parts, by a hash of its elements there, and with more than
d / 2 parts similar sets share a signature.  (Sets so small that d < 8 have
parts of one sub-part, and more than d of them.)  Each set signs in the band of
its own size, and in the next band where it can be the smaller partner; empty
subsets give no signature.

There are a few more parts than that, so similar sets share many signatures: all
but those that d differences can spoil, two with the first in a part and one
with the next.  A set that shares fewer than that with anything is out, and so
is one of which too few elements are in any other set that is left (both exact,
and without pairs); this clears passages that many otherwise different documents
share.  The sets left are grouped by the signatures that they share (a star per
signature, never its pairs), and inside a group the Jaccard similarity itself
decides, on whole sets.

A signature or element that several sets of a map task have is known to be
shared there and then: one of these sets stands for it in its bucket, so that no
bucket grows with the copies of a passage.

Equal sets are one class throughout.  They share a 64-bit key, the sum of their
mixed shingle hashes, and a second one from independent hashes of the words;
where sets of one key differ in the second, each is a class of its own.
Shingles are 64-bit hashes that mix every byte, so a pair of sets counts a
shingle wrongly with a probability of |r| * |s| / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import BROADCAST_BYTES, Scratch, estimated_bytes, stored, unused
from .superkmers import _pack, _unpack
from .text import BASE, NOT_SPACE, U64, Words, buffers, grams, mix, release, runs, spans

CHUNK = (1 << 20) - 2  # tables of powers have a power of two of entries
FLUSH = 1_200_000


class Bands:
    """Size bands of a threshold: for each size its band, the band's largest size and its number of parts."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.low, self.high = [0], [0]

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        while self.high[-1] < size:
            lo = self.high[-1] + 1
            self.low.append(lo)
            self.high.append(max(lo, int(lo / self.t)))
        return np.array(self.low), np.array(self.high)

    def differing(self, sizes: np.ndarray) -> np.ndarray:
        """The most elements in which two sets of this total size may differ."""
        n, d = self.t.numerator, self.t.denominator
        return sizes * (d - n) // (d + n)


def parts_of(high: np.ndarray, differing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a band, some more than must agree, and whether each has three sub-parts or one."""
    split = differing >= 8
    return np.where(split, ((differing // 2 + 1) * 23 + 19) // 20 + 3, (high * 9 + 19) // 20 + 8), split


class Sets:
    """The distinct shingles of some documents, as sorted hashes.  With `checked`, a second key from other hashes."""

    def __init__(self, words: Words, k: int, checked: bool = False):
        counts = words.counts()
        lengths = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        full = np.flatnonzero(counts >= k).tolist()
        short = np.flatnonzero((counts > 0) & (counts < k)).tolist()
        ends = np.cumsum(lengths)
        x = self._shingles(words, k, counts, lengths, ends, short, 0)
        if checked:
            order = np.arange(len(x))
            for d in full:
                a, b = ends[d] - lengths[d], ends[d]
                order[a:b] = a + np.argsort(x[a:b])
            x = x[order]
        else:
            for d in full:
                x[ends[d] - lengths[d] : ends[d]].sort()
        owner = np.repeat(np.arange(len(counts)), lengths)
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
        self.hashes, self.owner = x[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=len(counts))
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        self.keys = self._sum(self.hashes)
        if checked:
            self.checks = self._sum(self._shingles(words, k, counts, lengths, ends, short, 1)[order][new])

    @staticmethod
    def _shingles(words: Words, k: int, counts, lengths, ends, short: list[int], seed: int) -> np.ndarray:
        """The hashes of all shingles, in order of the text."""
        h = words.hashes(fold=True, seed=seed)
        g = grams(h, k)
        x = np.zeros(int(lengths.sum()), U64)
        at = np.repeat(words.docs[:-1] - (ends - lengths), lengths) + np.arange(len(x))
        long = np.repeat(counts >= k, lengths)
        x[long] = g[at[long]]
        for d in short:
            value = BASE ^ int(counts[d])
            for w in h[words.docs[d] : words.docs[d + 1]].tolist():
                value = (value * BASE + w) & (2**64 - 1)
            x[ends[d] - 1] = value
        return x

    def _sum(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(x ^ U64(BASE)), dtype=U64)))
            return mix(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.sizes.astype(U64)).view(np.int64)

    def signatures(self, docs: np.ndarray, band: np.ndarray, parts: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(signature, document) of each subset with elements, and for each document its parts with elements in one sub-part only, and in more (or in the only one).

        The documents (indexes into docs) have bands and numbers of parts.
        """
        size = self.sizes[docs]
        at = np.repeat(self.bounds[docs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        x, own = self.hashes[at], np.repeat(np.arange(len(docs)), size)
        none = np.zeros(len(docs), np.int64)
        if not len(x):
            return x, own, none, none
        part = ((x >> U64(32)) * parts.astype(U64)[own]) >> U64(32)
        new = np.ones(len(x), bool)
        new[1:] = (part[1:] != part[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        doc, part = own[first], part[first]
        sub = ((x & U64(0xFFFFFFFF)) * U64(3) >> U64(32)).astype(np.int8)
        sub[~split[own]] = 0
        sigs, docs_of, kinds = [], [], np.zeros(len(first), np.int64)
        with np.errstate(over="ignore"):
            x = mix(x ^ U64(0x5851F42D4C957F2D))
            total, n = np.add.reduceat(x, first), np.diff(np.append(first, len(x)))
            place = mix(part * U64(0x2545F4914F6CDD1D) + band.astype(U64)[doc])
            for j in range(3):  # without sub-part j
                inside = sub == j
                here = np.add.reduceat(inside.astype(np.int64), first)
                kinds += here > 0
                some = (n > here) & split[doc]
                rest = total - np.add.reduceat(np.where(inside, x, U64(0)), first)
                sigs.append(mix(rest[some] + place[some] + U64(j + 1)))
                docs_of.append(np.flatnonzero(some))
            whole = np.flatnonzero(~split[doc])
            sigs.append(mix(total[whole] + place[whole]))
            docs_of.append(whole)
        return np.concatenate(sigs), doc[np.concatenate(docs_of)], np.bincount(doc[(kinds == 1) & split[doc]], minlength=len(docs)), np.bincount(doc[(kinds > 1) | ~split[doc]], minlength=len(docs))


S1 = pa.schema([("bucket", pa.int32()), ("met", pa.bool_()), ("blob", pa.binary()), ("id", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("need_own", pa.int32()), ("need_low", pa.int32())])
S1_SQL = "bucket int, met boolean, blob binary, id long, row long, key long, check long, n long, need_own int, need_low int"
MEMBER = ("id", "row", "key", "check", "n", "need_own", "need_low")
S2 = pa.schema([("shared", pa.bool_()), *(S1.field(c) for c in MEMBER), ("sig", pa.int64()), ("role", pa.int32())])
S2_SQL = "shared boolean, id long, row long, key long, check long, n long, need_own int, need_low int, sig long, role int"
#: Sent to a bucket: for each set key, role and number of signatures; 32 and 8 bits of each signature, and whether other sets of the task have it.  Already met: key, role and signature.
SENT, MET = [np.int64, np.uint8, np.uint32, np.uint32, np.uint8, np.uint8], [np.int64, np.uint8, np.uint64]


#: Bits of a hash that tell signatures of a bucket apart; the bucket's number stands above them, in up to 27 bits.
HASH_BITS = 36


def _short(hashes: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """What is sent of a hash, with its bucket: the same from all tasks."""
    return hashes & U64((1 << HASH_BITS) - 1) | bucket.astype(U64) << U64(HASH_BITS)


class _Held:
    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.seen: set[tuple[int, int]] = set()
        self.docs = self.size = 0

    def add(self, sig: np.ndarray, own: np.ndarray, role: np.ndarray, buckets: int) -> None:
        """Signatures of sets, by their numbers here, as what is sent of them with the role in the lowest bit."""
        bucket = ((sig >> U64(32)) * U64(buckets)) >> U64(32)
        self.parts.append((_short(sig, bucket) << U64(1) | role.astype(U64), own.astype(np.uint32)))
        self.size += len(sig)

    def flush(self) -> Iterator[tuple[int, bool, bytes]]:
        """(bucket, whether its sets have met, packed signatures)."""
        if self.parts:
            keys = np.concatenate(self.keys)
            sig, own = (np.concatenate(x) for x in zip(*self.parts))
            self.__init__()
            order = np.argsort(sig)
            sig, own = sig[order], own[order]
            del order
            b = runs(sig >> U64(1))
            many = np.repeat(np.diff(b) > 1, np.diff(b))
            first = np.zeros(len(sig), bool)
            first[b[:-1]] = True  # one set stands for those that met, of the band itself if any is
            met = np.flatnonzero(many & ~first)
            for lo in range(0, len(met), 1 << 16):
                part = met[lo : lo + (1 << 16)]
                yield int(sig[part[len(part) // 2]] >> U64(HASH_BITS + 1)), True, _pack(keys[own[part]], (sig[part] & U64(1)).astype(np.uint8), sig[part] >> U64(1))
            sig, own, many = sig[first], own[first], many[first]
            del first, met, b
            order = np.argsort((sig >> U64(HASH_BITS + 1)) << U64(33) | own.astype(U64) << U64(1) | sig & U64(1))
            sig, own, many = sig[order], own[order], many[order]
            del order
            b = runs(sig >> U64(HASH_BITS + 1))
            for lo, hi in zip(b[:-1].tolist(), b[1:].tolist()):
                who = own[lo:hi].astype(np.int64) << 1 | (sig[lo:hi] & U64(1)).astype(np.int64)
                r = runs(who)
                s = sig[lo:hi] >> U64(1)
                who = who[r[:-1]]
                yield int(sig[lo] >> U64(HASH_BITS + 1)), False, _pack(keys[who >> 1], (who & 1).astype(np.uint8), np.diff(r).astype(np.uint32), s.astype(np.uint32), (s >> U64(32) & U64(15)).astype(np.uint8), many[lo:hi].view(np.uint8))
        self.__init__()


def sign(sets: Sets, bands: Bands, docs: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """(signature, index into docs, role) of the documents, and how many each must share in its own band and as the smaller partner in the next."""
    size = sets.sizes[docs]
    low, high = bands.upto(int(size.max(initial=1) / bands.t) + 1)
    parts, split = parts_of(high, bands.differing(2 * high))
    band = np.searchsorted(high, size)
    out, needs = [], []
    for role in (0, 1):
        b = band + role
        near = np.ones(len(docs), bool) if role == 0 else (size / float(bands.t) + 1e-9).astype(np.int64) >= low[b]
        own = np.flatnonzero(near)
        sig, of, one, more = sets.signatures(docs[own], b[own], parts[b[own]], split[b[own]])
        of = own[of]
        d = bands.differing(size + high[b])[own]
        need = np.full(len(docs), -1)
        # The first difference in a part spoils two of its signatures, the next the third.
        shared = np.where(d <= one + more, 2 * one + 3 * more - 2 * d, one + 2 * more - d)
        need[own] = np.where(split[b[own]], shared, more - d)
        # With nothing that must agree, all such sets of a band meet under one more signature.
        weak = own[need[own] <= 0]
        if len(weak):
            sig = np.concatenate((sig, mix(b[weak].astype(U64) ^ U64(0xABCDEF))))
            of = np.concatenate((of, weak))
            need[weak] = 1
        out.append((sig, of, np.full(len(sig), role)))
        needs.append(need)
    return tuple(np.concatenate(x) for x in zip(*out)), needs[0], needs[1]


def _sign(buckets: int, k: int, threshold: Fraction, key_bits: int):
    def blobs(held: _Held) -> Iterator[pa.RecordBatch]:
        for b, met, blob in held.flush():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([met]), pa.array([blob], pa.binary()), *(pa.nulls(1, f.type) for f in list(S1)[3:])], schema=S1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held = Bands(threshold), _Held()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in spans(offsets, CHUNK):
                sets = Sets(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE), k, True)
                keys = sets.keys >> (64 - key_bits)
                docs = np.arange(j - i)
                mine = docs[sets.sizes > 0]
                need_own, need_low = np.zeros(j - i, np.int32), np.zeros(j - i, np.int32)
                (sig, of, role), a, b = sign(sets, bands, mine)
                need_own[mine], need_low[mine] = a, b
                fresh = np.zeros(len(mine), bool)  # a set that this task has signed since the last flush is not signed again
                for x, key in enumerate(zip(keys[mine].tolist(), sets.checks[mine].tolist())):
                    if key not in held.seen:
                        held.seen.add(key)
                        fresh[x] = True
                take = fresh[of]
                number = held.docs + np.cumsum(fresh) - 1
                held.add(sig[take], number[of[take]], role[take], buckets)
                held.keys.append(keys[mine][fresh])
                held.docs += int(fresh.sum())
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.arange(i, j) * 7919 % buckets).astype(np.int32)), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()), batch.column("id").slice(i, n), batch.column("row").slice(i, n), pa.array(keys), pa.array(sets.checks), pa.array(sets.sizes, pa.int64()), pa.array(need_own), pa.array(need_low)],
                    schema=S1,
                )
                if held.size >= FLUSH:
                    yield from blobs(held)
        yield from blobs(held)
        release()

    return run


def _meet(blobs: list[bytes], bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, signature, role) of the bucket's signatures that a set shares with a possible partner."""
    # One number a signature: its hash, whether it has met others, its role, and the place of its set among all that were sent.
    parts, keys, held = [], [], 0
    for blob in blobs:
        key, role, count, lo, hi, many = _unpack(blob, SENT)
        place = held + np.arange(len(key), dtype=np.int64)
        own = np.repeat(place.astype(U64) << U64(1) | role.astype(U64), count)
        parts.append((lo.astype(U64) | hi.astype(U64) << U64(32)) << U64(28) | many.astype(U64) << U64(27) | own)
        keys.append(key)
        held += len(key)
    if held >> 26:
        raise ValueError("too many sets in a bucket: lower bucket_signatures")
    key, all_ = np.concatenate(keys), np.concatenate(parts)
    del parts, keys
    all_.sort()
    b = runs(all_ >> U64(28))
    shared = np.diff(b) > 1
    shared[~shared] = (all_[b[:-1][~shared]] >> U64(27) & U64(1)).astype(bool)
    all_ = all_[np.repeat(shared, np.diff(b))]
    sig, many, role = all_ >> U64(28), (all_ >> U64(27) & U64(1)).astype(bool), (all_ & U64(1)).astype(np.uint8)
    key = key[(all_ >> U64(1) & U64((1 << 26) - 1)).astype(np.int64)]
    del all_
    if len(sig):
        order = np.lexsort((role, key, sig))
        sig, key, role, many = sig[order], key[order], role[order], many[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(new)
        many = np.logical_or.reduceat(many, at)
        sig, key, role = sig[at], key[at], role[at]
        b = runs(sig)
        sizes = np.diff(b)
        met = np.logical_or.reduceat(many, b[:-1])
        whole = np.add.reduceat((role == 0).astype(np.int64), b[:-1])
        keep = np.repeat(((sizes > 1) | met) & (whole > 0), sizes)  # two smaller partners meet in their own band
        sig, key, role = sig[keep], key[keep], role[keep]
    return key, _short(sig, np.full(len(sig), bucket)), role


def _blobs(batch: pa.RecordBatch, column: str) -> Iterator[tuple]:
    """(bucket, value of the column, blob) of the rows that have a blob; blobs are not copied."""
    bucket, other, blob = batch.column("bucket"), batch.column(column), batch.column("blob")
    for i in np.flatnonzero(blob.is_valid().to_numpy(zero_copy_only=False)).tolist():
        yield bucket[i].as_py(), other[i].as_py(), blob[i].as_buffer()


def _share():
    def shown(key: np.ndarray, sig: np.ndarray, role: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(key), 100_000):
            n = len(key[i : i + 100_000])
            rows = {f.name: pa.nulls(n, f.type) for f in S2} | {"shared": pa.array(np.ones(n, bool)), "key": pa.array(key[i : i + n]), "sig": pa.array(sig[i : i + n].view(np.int64)), "role": pa.array(role[i : i + n], pa.int32())}
            yield pa.RecordBatch.from_arrays(list(rows.values()), schema=S2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            plain = batch.filter(batch.column("blob").is_null())
            n = plain.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), *(plain.column(c) for c in MEMBER), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], schema=S2)
            for b, met, blob in _blobs(batch, "met"):
                if met:
                    key, role, sig = _unpack(blob, MET)
                    yield from shown(key, sig, role)
                    continue
                if b != now:
                    if held:
                        yield from shown(*_meet(held, now))
                    held, now = [], b
                held.append(blob)
        if held:
            yield from shown(*_meet(held, now))
        del held
        release()

    return run


SETS = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary())])
SETS_SQL = "key long, class long, n long, shingles binary"


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task gives a set once
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            keys, names = batch.column("key").to_numpy(), batch.column("class").to_numpy()
            for i, j in spans(offsets, CHUNK):
                sets = Sets(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_SPACE), k)
                fresh = np.array([x for x, key in enumerate(names[i:j].tolist()) if key not in seen and not seen.add(key)], np.int64)
                raw = [sets.hashes[a:b].tobytes() for a, b in zip(sets.bounds[fresh].tolist(), sets.bounds[fresh + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j][fresh]), pa.array(names[i:j][fresh]), pa.array(sets.sizes[fresh], pa.int64()), pa.array(raw, pa.binary())], schema=SETS)

    return run


SCATTERED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("class", pa.int64()), ("shared", pa.int64())])
COUNTED = pa.schema([("class", pa.int64()), ("shared", pa.int64())])


def _scatter(buckets: int):
    """The elements of sets, packed by bucket; of those that several sets of a flush have, how many each set has, and one to stand for each."""

    def flush(keys: list[np.ndarray], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        name = np.concatenate(keys)
        x, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(x, kind="stable")
        x, own = x[order], own[order]
        b = runs(x)
        many = np.repeat(np.diff(b) > 1, np.diff(b))
        local = np.bincount(own[many], minlength=len(sets))
        some = np.flatnonzero(local)
        yield pa.RecordBatch.from_arrays([pa.array((some * 7919 % buckets).astype(np.int32)), pa.nulls(len(some), pa.binary()), pa.array(name[some]), pa.array(local[some])], schema=SCATTERED)
        at = b[:-1]
        x, own, many = x[at], own[at], many[at]
        bucket = (x >> U64(32)) * U64(buckets) >> U64(32)
        order = np.argsort((bucket << U64(32)) | own.astype(U64), kind="stable")
        x, own, many, bucket = x[order], own[order], many[order], bucket[order]
        b = runs(bucket)
        for lo, hi in zip(b[:-1].tolist(), b[1:].tolist()):
            r = runs(own[lo:hi])
            blob = _pack(name[own[lo:hi][r[:-1]]], np.diff(r).astype(np.uint32), x[lo:hi].astype(np.uint32), (x[lo:hi] >> U64(32)).astype(np.uint8), many[lo:hi].view(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[lo])], pa.int32()), pa.array([blob], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=SCATTERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sets, size = [], [], 0
        for batch in batches:
            for name, raw in zip(batch.column("class").to_pylist(), batch.column("shingles")):
                keys.append(np.array([name], np.int64))
                sets.append(np.frombuffer(raw.as_buffer(), U64))
                size += len(sets[-1])
                if size >= FLUSH:
                    yield from flush(keys, sets)
                    keys, sets, size = [], [], 0
        if sets:
            yield from flush(keys, sets)
        del keys, sets
        release()

    return run


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of its elements in the bucket each set shares, but for those that its task has counted."""

    def done(blobs: list[bytes]) -> pa.RecordBatch:
        keys, elements, known = [], [], []
        for blob in blobs:
            key, count, lo, hi, many = _unpack(blob, [np.int64, np.uint32, np.uint32, np.uint8, np.uint8])
            keys.append(np.repeat(key, count))
            elements.append(lo.astype(U64) | hi.astype(U64) << U64(32))
            known.append(many.view(bool))
        key, x, many = np.concatenate(keys), np.concatenate(elements), np.concatenate(known)
        order = np.lexsort((key, x))
        key, x, many = key[order], x[order], many[order]
        b = runs(x)
        met = np.logical_or.reduceat(many, b[:-1]) | (key[b[:-1]] != key[b[1:] - 1])
        name, n = np.unique(key[np.repeat(met, np.diff(b)) & ~many], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], schema=COUNTED)

    held, now = [], None
    for batch in batches:
        plain = batch.filter(batch.column("blob").is_null())
        yield pa.RecordBatch.from_arrays([plain.column("class"), plain.column("shared")], schema=COUNTED)
        for b, _, blob in _blobs(batch, "bucket"):
            if b != now:
                if held:
                    yield done(held)
                held, now = [], b
            held.append(blob)
    if held:
        yield done(held)
    del held
    release()


def link(keys: np.ndarray, sets: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """For each set, the smallest key that is reachable over pairs of at least the threshold's Jaccard similarity."""
    num, den = threshold.numerator, threshold.denominator
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    label = np.arange(n)
    live = np.arange(n)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    while len(live) > 1:  # a set with too few elements that any other has cannot be linked
        own = [flat[ends[i] - sizes[i] : ends[i]] for i in live.tolist()]
        count = np.bincount(np.concatenate(own), minlength=len(flat))
        ok = np.array([den * int((count[o] > 1).sum()) >= num * len(o) for o in own])
        if ok.all():
            break
        live = live[ok]
    live = live[np.argsort(sizes[live], kind="stable")]
    own = [flat[ends[i] - sizes[i] : ends[i]] for i in live.tolist()]
    size = sizes[live]
    bounds = np.concatenate(([0], np.cumsum(size)))
    all_own = np.concatenate(own) if own else flat[:0]
    mark = np.zeros(len(flat) + 1, bool)
    for x in range(len(live)):  # each set against the larger ones it may reach and is not yet joined to
        last = int(np.searchsorted(size, size[x] * den // num, "right"))
        if last <= x + 1:
            continue
        rest = np.arange(x + 1, last)
        apart = label[live[rest]] != label[live[x]]
        if not apart.any():
            continue
        mark[own[x]] = True
        both = np.add.reduceat(mark[all_own[bounds[x + 1] : bounds[last]]].astype(np.int64), bounds[x + 1 : last] - bounds[x + 1])
        mark[own[x]] = False
        linked = rest[(den * both >= num * (size[x] + size[rest] - both)) & apart]
        if len(linked):
            joined = np.unique(np.append(label[live[linked]], label[live[x]]))
            label[np.isin(label, joined)] = joined[0]
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, label, keys)
    return low[label]


def _link(threshold: Fraction):
    out = pa.schema([("key", pa.int64()), ("label", pa.int64())])

    def done(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            keys = np.array(sorted(held), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(link(keys, [held[x] for x in keys.tolist()], threshold))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = {}, None
        for batch in batches:
            for c, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if c != now:
                    yield from done(held)
                    held, now = {}, c
                if key not in held:
                    held[key] = np.frombuffer(raw.as_buffer(), U64)
        yield from done(held)

    return run


def _link_blocks(threshold: Fraction, task_shingles: int):
    """Links inside bounded blocks of a large component."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def done(held: dict[int, dict[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for own in held.values():
            keys = np.array(sorted(own), np.int64)
            labels = link(keys, [own[x] for x in keys.tolist()], threshold)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(labels)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for c, key, raw in zip(batch.column("component").to_pylist(), batch.column("key").to_pylist(), batch.column("shingles")):
                if key in held.setdefault(c, {}):
                    continue
                held[c][key] = np.frombuffer(raw.as_buffer(), U64)
                size += len(held[c][key])
                if size >= task_shingles:
                    yield from done(held)
                    held, size = {}, 0
        yield from done(held)

    return run


def _compare(asked, threshold: Fraction):
    """Links of the asked sets (component: label, set) with sets of other labels, as pairs of labels."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, list[tuple[int, np.ndarray]]] = asked.value
        for batch in batches:
            component, label = batch.column("component").to_numpy(), batch.column("label").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), U64) for x in batch.column("shingles")]
            pairs = set()
            for c in np.unique(component).tolist():
                at = np.flatnonzero(component == c)
                if c not in queries:
                    continue
                size = np.array([len(sets[i]) for i in at.tolist()])
                flat, owner = np.concatenate([sets[i] for i in at.tolist()]), np.repeat(np.arange(len(at)), size)
                order = np.argsort(flat)
                flat, owner = flat[order], owner[order]
                for name, q in queries[c]:
                    low = np.searchsorted(flat, q, "left")
                    n = np.searchsorted(flat, q, "right") - low
                    where = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both = np.bincount(owner[where], minlength=len(at))
                    hit = (label[at] != name) & (den * both >= num * (size + len(q) - both))
                    pairs |= {(name, x) for x in np.unique(label[at[hit]]).tolist()}
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=out)

    return run


#: Edges of a graph that one task joins, a few MB; larger graphs are contracted first.
TASK_EDGES = 1 << 17

#: Bytes of sets that are broadcast at once.
ASKED_BYTES = 16 << 20


def _large_links(sets: DataFrame, threshold: Fraction, task_shingles: int) -> DataFrame:
    """(key, label) for components too large for one task; labels agree exactly where links lead.

    Bounded blocks of a component are linked by themselves first.  One set of
    each label that has many meets all others next, which joins what blocks
    have cut.  Every link that is still missing has an end outside the
    component's most frequent label; the sets there meet all others as well.
    """
    big = stored(sets.repartitionByRange("component", "key").sortWithinPartitions("component"), "sets")
    inside = connected_components(big.mapInArrow(_link_blocks(threshold, task_shingles), "a long, b long"), task_edges=TASK_EDGES)
    labelled = stored(big.join(inside.toDF("key", "named"), "key", "left").select("component", "key", F.coalesce("named", "key").alias("label"), "shingles"), "labelled")
    many = stored(labelled.groupBy("component", "label").agg(F.count("*").alias("n")).where(F.col("n") >= MANY).select("component", F.col("label").alias("key")), "many")
    labelled = _joined(labelled, labelled.join(many, ["component", "key"], "left_semi"), threshold)
    main = stored(labelled.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main")), "main")
    return _joined(labelled, labelled.join(main, "component").where("label <> main"), threshold).select("key", "label").distinct()


#: A label of so many sets asks by one of them first.
MANY = 16


def _joined(labelled: DataFrame, asking: DataFrame, threshold: Fraction) -> DataFrame:
    """`labelled` with one label where sets of `asking`, broadcast in bounded blocks, are linked with sets of another; those answer with the labels, not with pairs of sets."""
    spark = labelled.sparkSession
    pairs: list[DataFrame] = []
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    size = 0
    for r in chain(stored(asking.select("component", "label", "shingles"), "asking").toLocalIterator(), [None]):
        if r is not None:
            q = np.frombuffer(bytes(r["shingles"]), U64)
            held.setdefault(r["component"], []).append((r["label"], q))
            size += q.nbytes
        if held and (r is None or size >= ASKED_BYTES):
            pairs.append(stored(labelled.mapInArrow(_compare(spark.sparkContext.broadcast(held), threshold), "a long, b long").distinct(), "pairs"))
            held, size = {}, 0
    if not pairs:
        return labelled
    joined = connected_components(reduce(DataFrame.unionByName, pairs), task_edges=TASK_EDGES).toDF("label", "to")
    return stored(labelled.join(joined, "label", "left").select("component", "key", F.coalesce("to", "label").alias("label"), "shingles"), "joined")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: Fraction = Fraction(3, 4), bucket_signatures: int = 2_000_000, task_shingles: int = 1 << 18, key_bits: int = 64) -> DataFrame:
    """One row (id, n_shingles, component, row, group) for each row of `documents`.

    Words are A-Z lower-cased; a text of fewer than `k` words is one shingle.
    component is the smallest id that is reachable over links, the row's own
    included.  A null, empty or blank text has no shingle and no link.  Rows
    that repeat an id are rows of their own; a null id is never the smallest
    (component is null only where all ids are).  bucket_signatures bounds the
    signatures, task_shingles the shingles of linked sets that a task holds;
    larger groups are split over tasks.  key_bits: how many of the first key's
    bits are used (fewer are for tests: the result is the same).  row is a hash of the text that
    tells rows of one id apart, group a number for all linked rows (null
    without shingles).  Other columns are not read.
    """
    with Scratch(documents.sparkSession) as scratch:
        return _near_duplicates(documents, id_col, text_col, k, threshold, bucket_signatures, task_shingles, key_bits, scratch)


def _near_duplicates(documents: DataFrame, id_col: str, text_col: str, k: int, threshold: Fraction, bucket_signatures: int, task_shingles: int, key_bits: int, scratch: Scratch) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    buckets = max(32, estimated_bytes(documents, text_col) // 4 // bucket_signatures)
    sent = docs.mapInArrow(_sign(buckets, k, threshold, key_bits), S1_SQL)
    met = stored(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_share(), S2_SQL), "signatures")
    members = met.where("not shared").select(*MEMBER)
    head = F.min(F.struct("id", "row")).alias("head"), F.min("id").alias("low"), F.max("n").alias("n")
    keys = members.where("n > 0").groupBy("key").agg(*head, F.min("need_own").alias("need_own"), F.min("need_low").alias("need_low"), F.min("check").alias("a"), F.max("check").alias("b"))
    keys = stored(keys, "classes")
    clash = keys.where("a <> b").select("key")
    clashes = not clash.isEmpty()
    if clashes:  # sets of one key that the second key tells apart
        split = members.join(clash.withColumn("apart", F.lit(True)), "key", "left")
        members = split.withColumn("class", F.when(F.col("apart"), F.xxhash64("key", "check")).otherwise(F.col("key")))
        classes = stored(members.where("n > 0").groupBy("key", "class").agg(*head), "classes")
    else:
        members = members.withColumn("class", F.col("key"))
        classes = keys.select("key", F.col("key").alias("class"), "head", "low", "n")

    # Sets that share enough signatures, and enough elements with one another.
    shared = met.where("shared").select("key", "sig", "role")
    counts = shared.groupBy("key").agg(F.count(F.when(F.col("role") == 0, 1)).alias("own"), F.count(F.when(F.col("role") == 1, 1)).alias("small"))
    enough = (F.col("own") >= F.col("need_own")).alias("as_own"), ((F.col("need_low") > 0) & (F.col("small") >= F.col("need_low"))).alias("as_small")
    left = counts.join(keys, "key").select("key", *enough).where("as_own or as_small")
    if clashes:  # equal keys are candidates of themselves
        left = left.unionByName(clash.join(left, "key", "left_anti").select("key", F.lit(False).alias("as_own"), F.lit(False).alias("as_small")))
    left = stored(left, "left")
    asked = stored(left.join(classes, "key").select("key", "class", F.col("head.id").alias("id"), F.col("head.row").alias("row")), "asked")
    if asked.count() * 64 <= BROADCAST_BYTES:
        asked = F.broadcast(asked)
    sets = docs.alias("d").join(asked.alias("a"), F.expr("d.row = a.row and d.id <=> a.id")).select("key", "class", "text")
    sets = stored(sets.mapInArrow(_sets(k), SETS_SQL), "sets")
    spread = max(32, (sets.agg(F.sum("n")).first()[0] or 0) // bucket_signatures)
    found = sets.mapInArrow(_scatter(spread), "bucket int, blob binary, class long, shared long").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count_shared, "class long, shared long")
    found = found.groupBy("class").agg(F.sum("shared").alias("shared"))
    live = sets.join(found, "class").where(F.col("shared") * threshold.denominator >= F.col("n") * threshold.numerator)
    live = stored(live.select("key", "class", "n"), "live")

    # Groups of the sets that are left.
    still = left.join(live.select("key").distinct(), "key")
    kept = stored(shared.join(still, "key").where("(role = 0 and as_own) or (role = 1 and as_small)").select("sig", "key", "role"), "kept")
    stars = kept.groupBy("sig").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min("role").alias("least")).where("first <> last and least = 0").select("sig", "first")
    groups = connected_components(kept.join(stars, "sig").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")), task_edges=TASK_EDGES).toDF("key", "component")
    if clashes:
        groups = groups.unionByName(clash.join(groups, "key", "left_anti").select("key", F.col("key").alias("component")))
    members_of = stored(live.join(groups, "key").select("class", "component", "n"), "groups")
    large = stored(members_of.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > task_shingles).select("component"), "large")

    marked = members_of.join(large.withColumn("big", F.lit(True)), "component", "left").select("class", "component", F.coalesce("big", F.lit(False)).alias("big"))
    marked = stored(marked, "marked")
    if marked.count() * 32 <= BROADCAST_BYTES:
        marked = F.broadcast(marked)
    grouped = sets.join(marked, "class").select("component", F.col("class").alias("key"), "shingles", "big")
    small = grouped.where("not big").drop("big")
    links = stored(small.repartition("component").sortWithinPartitions("component").mapInArrow(_link(threshold), "key long, label long"), "links")
    if not large.isEmpty():
        links = stored(links.unionByName(_large_links(grouped.where("big").drop("big"), threshold, task_shingles)), "links")
    # Classes that are linked take the smallest id of their label; all others have their own.
    links = links.withColumnRenamed("key", "class")
    if links.count() * 32 <= BROADCAST_BYTES:
        links = F.broadcast(links)
    linked = stored(classes.join(links, "class").select("class", "low", "label"), "linked")
    lows = linked.groupBy("label").agg(F.min("low").alias("component"))
    named = stored(linked.join(lows, "label").select("class", "component", F.col("label").alias("group")), "named")
    scratch.keep(met, keys, classes, named)
    named = classes.select("class", "low").join(named, "class", "left").select("class", F.coalesce("component", "low").alias("component"), F.coalesce("group", "class").alias("group"))
    alone = F.when(F.col("n") == 0, F.col("id"))
    return members.join(named, "class", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce(alone, "component").alias("component"), "row", "group")


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`documents` with the row of the smallest id of each group of linked rows; columns unchanged.

    Of rows without shingles all stay; of rows that repeat an id and a text one
    stays; a null id stays only where all of its group are null.
    """
    rows = near_duplicates(documents, id_col=id_col, text_col=text_col, **options).where("group is not null").groupBy("group", "id", "row").agg(F.count("*").alias("n"))
    rows = stored(rows, "groups")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("r")).select("group", F.col("r.id").alias("to"), F.col("r.row").alias("to_row"))
    gone = stored(rows.join(first, "group").where("not (id <=> to) or row <> to_row").select("id", "row"), "gone")
    if gone.count() * 32 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    row = unused(documents, "row_")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = documents.withColumn(row, F.xxhash64(text)).alias("all")
    kept = kept.join(gone.alias("gone"), F.col(f"all.{id_col}").cast("long").eqNullSafe(F.col("gone.id")) & (F.col(f"all.{row}") == F.col("gone.row")), "left_anti")
    if not rows.where("n > 1").isEmpty():
        # Rows that repeat: one of each, by the same key.
        blank = F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")) == 0
        kept = kept.where(~blank).dropDuplicates([id_col, row]).unionByName(kept.where(blank))
    return kept.drop(row)


def near_duplicates_report(documents: DataFrame, **options) -> DataFrame:
    """The columns of the contract."""
    r = near_duplicates(documents, **options)
    return r.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


#: The same for DuckDB.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) t(i)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
m(x, y) AS (SELECT r, r FROM d UNION SELECT m.x, e.y FROM m JOIN e ON e.x = m.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, CASE WHEN any_value(n.n) IS NULL THEN d.doc_id ELSE min(o.doc_id) END AS component_id
FROM d JOIN m ON m.x = d.r JOIN d o ON o.r = m.y LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
