"""Language identification by prediction by partial matching (operator 4).

For every language a tree of byte contexts of up to `order` bytes is counted on
a bounded sample of labelled texts and then frozen.  A byte is coded in the
longest context that has been seen; with the probability that method C gives to
the unseen, the coder escapes to the next shorter context, where the bytes that
the longer one knows are excluded; below the empty context all bytes left are
alike.  A text's code length under a language is the sum over its bytes, and
the language with the shortest code is the answer.

Since statistics are frozen, the code length of a byte depends only on the
bytes before it.  All contexts of one length that share what they predict are
numbered, and a table holds the code length of each byte after each number, so
scoring is two look-ups a byte, done on whole batches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import FOLD, buffers, release, spans

CHUNK = 1 << 20


class Model:
    """Frozen trees of all languages as look-up tables.

    symbols: the number of each byte (0: never seen in training);
    contexts: for each triple of symbols, the number of its context;
    cost: bits, indexed [context * symbols + symbol, language].
    """

    def __init__(self, langs: list[str], symbols: np.ndarray, contexts: np.ndarray, cost: np.ndarray, order: int):
        self.langs, self.symbols, self.contexts, self.cost, self.order = langs, symbols, contexts, cost, order
        self.n = int(symbols.max()) + 1

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return out
        # Each text is preceded by blanks, so that no context reaches into another text.
        pad, n, m = self.order, self.n, len(offsets) - 1
        s = np.full(len(data) + pad * (m + 1), self.symbols[0x20], np.int32)
        at = np.arange(len(data)) + np.repeat((np.arange(m) + 1) * pad, np.diff(offsets))
        s[at] = self.symbols[FOLD[data]]
        code = s[:-pad].copy()
        for j in range(1, pad):
            code = code * n + s[j : len(s) - pad + j]
        row = self.contexts[code] * n + s[pad:]
        row = row[at - pad]
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            for q in range(len(self.langs)):
                out[full, q] = np.add.reduceat(self.cost[q][row], offsets[full], dtype=np.float64)
        return out


def _distribution(counts: list[np.ndarray], escape: np.ndarray) -> np.ndarray:
    """Probabilities of all bytes, given their counts in each context from the longest that has been seen to the empty one."""
    p = np.zeros(256)
    left, free = 1.0, np.ones(256, bool)
    for c in counts:
        c = np.where(free, c, 0)
        total, kinds = c.sum(), np.count_nonzero(c)
        if not total:
            continue
        p += left * c / (total + kinds)
        left *= kinds / (total + kinds)
        free &= c == 0
    return p + left * free / max(1, free.sum())


#: What a model's table of code lengths may take, in bytes.
MOST_BYTES = 256 << 20


def build(counts: list[tuple[str, bytes, int]], order: int, least: int = 2, max_bytes: int = MOST_BYTES) -> Model:
    """The model of (language, order + 1 bytes, count) triples.

    Contexts seen fewer than `least` times are merged into the next shorter
    one; least doubles until the table of code lengths fits max_bytes.
    """
    langs = sorted({c[0] for c in counts})
    trees: dict[str, list[dict[bytes, np.ndarray]]] = {}
    seen = np.zeros(256, bool)
    seen[0x20] = True
    for lang in langs:
        trees[lang] = [defaultdict(lambda: np.zeros(256)) for _ in range(order + 1)]
    for lang, gram, n in counts:
        for k in range(order + 1):
            trees[lang][k][gram[order - k : order]][gram[order]] += n
        seen[list(gram)] = True
    symbols = np.zeros(256, np.int32)
    symbols[seen] = np.arange(1, int(seen.sum()) + 1)
    byte_of = np.flatnonzero(seen)
    n = len(byte_of) + 1
    # A context counts as one of its own if any language has seen it often enough.
    sums = [[(c, v.sum()) for lang in langs for c, v in trees[lang][k].items()] for k in range(order + 1)]
    while True:
        known: list[dict[bytes, int]] = []
        number = 0
        for k in range(order + 1):
            often = sorted({c for c, v in sums[k] if v >= least or k == 0} | ({b""} if k == 0 else set()))
            known.append({c: number + i for i, c in enumerate(often)})
            number += len(often)
        if number * n * 4 * len(langs) <= max_bytes or number == 1:
            break
        least *= 2
    cost = np.zeros((len(langs), number * n), np.float32)
    for q, lang in enumerate(langs):
        tree = trees[lang]
        for k in range(order + 1):
            for c, at in known[k].items():
                chain = [tree[j][c[k - j :]] for j in range(k, -1, -1) if c[k - j :] in tree[j]]
                p = -np.log2(_distribution(chain, None))
                cost[q, at * n + 1 : at * n + n] = p[byte_of]
                cost[q, at * n] = p[~seen].mean() if not seen.all() else 8
    contexts = np.zeros(n**order, np.int32)
    for k in range(1, order + 1):  # longer contexts overwrite shorter ones
        for c, at in known[k].items():
            code = 0
            for b in c:
                code = code * n + int(symbols[b])
            contexts[code :: n**k] = at
    return Model(langs, symbols, contexts, cost, order)


def _count(order: int):
    out = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            data, offsets = buffers(batch.column("text"))
            for i, text in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                raw = FOLD[data[text[0] : text[1]]].astype(np.uint64)
                s = np.concatenate((np.full(order, 0x20, np.uint64), raw))
                code = np.zeros(len(raw), np.uint64)
                for j in range(order + 1):
                    code = code * np.uint64(256) + s[j : j + len(raw)]
                totals.setdefault(langs[i], []).append(code)
                if len(totals[langs[i]]) >= 256:
                    totals[langs[i]] = [_merge(totals[langs[i]])]
        for lang, codes in totals.items():
            both = _merge(codes)
            for a in range(0, len(both), 50_000):
                part = both[a : a + 50_000]
                grams = [int(c).to_bytes(order + 1, "big") for c in part["c"].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(grams, pa.binary()), pa.array(part["n"])], schema=out)
        totals.clear()
        release()

    return run


def _merge(codes: list[np.ndarray]) -> np.ndarray:
    new = [c for c in codes if c.dtype.names is None]
    old = [c for c in codes if c.dtype.names]
    values = [np.concatenate(new)] if new else []
    weights = [np.ones(len(v), np.int64) for v in values]
    for o in old:
        values.append(o["c"])
        weights.append(o["n"])
    v, inverse = np.unique(np.concatenate(values), return_inverse=True)
    out = np.zeros(len(v), [("c", np.uint64), ("n", np.int64)])
    out["c"] = v
    np.add.at(out["n"], inverse, np.concatenate(weights))
    return out


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = 3, sample_rows: int = 3000, max_bytes: int = MOST_BYTES) -> Model:
    """Fit on about `sample_rows` whole texts of each language, chosen by a hash of id and text.

    sample_rows bounds what training reads of a language and what the driver
    gets: the counts of at most that many texts' (order + 1)-grams.  Rows with
    a null text or language teach nothing.  No labelled row: no language.
    max_bytes bounds the model, which is broadcast.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")).where("lang is not null and text is not null")
    share = {r["lang"]: sample_rows / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model([], np.ones(256, np.int32), np.zeros(2**order, np.int32), np.zeros((0, 2), np.float32), order)
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen: Column = F.lit(False)
    for lang, p in sorted(share.items()):
        chosen = chosen | ((F.col("lang") == lang) & (draw < p))
    counts = rows.where(chosen).select("lang", "text").mapInArrow(_count(order), "lang string, gram binary, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build([(r["lang"], bytes(r["gram"]), r["n"]) for r in counts.toLocalIterator()], order, max_bytes=max_bytes)


#: Nats of difference in a byte's mean code length, over this many bytes at most, make the score.
EVIDENCE = 24


def _score(model):
    out = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
    letters = np.zeros(256, bool)
    letters[0x41:0x5B] = letters[0x61:0x7B] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            texts = batch.column("text")
            data, offsets = buffers(texts)
            for i, j in spans(offsets, CHUNK):
                raw, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                langs, scores, means = classify(m, raw, at, letters)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(langs, pa.string()), pa.array(scores), pa.array(means)], schema=out)
        release()

    return run


def classify(m: Model, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    n = np.diff(offsets)
    sums = np.concatenate(([0], np.cumsum(letters[data])))
    has = sums[offsets[1:]] > sums[offsets[:-1]]
    for d in np.flatnonzero(~has & (n > 0)).tolist():  # no ASCII letter: what is beyond ASCII may be letters or signs
        raw = data[offsets[d] : offsets[d + 1]]
        has[d] = bool((raw >= 0x80).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
    if not m.langs:
        return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n))
    mean = m.bits(data, offsets) / np.maximum(n, 1)[:, None]
    best = mean.argmin(axis=1)
    low = mean[np.arange(len(n)), best]
    weight = np.exp((low[:, None] - mean) * np.log(2) * np.minimum(n, EVIDENCE)[:, None])
    score = np.where(has, 1 / weight.sum(axis=1), 0.0)
    return [m.langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())], score, low


def identify(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, lang, score, bits_per_byte) for each row of `documents`, from its whole text alone.

    lang is `und` with score 0 where the text is null or has no letter (and
    without any learned language).  score is the posterior of the language
    among all learned ones at equal priors, with evidence counted for at most
    24 bytes, so that long texts of mixed language stay below 1; equal code
    lengths go to the first language by name.  A-Z count as a-z.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(shared), "id long, lang string, score double, bits_per_byte double")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model may learn from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def language_report(documents: DataFrame, **options) -> DataFrame:
    """The columns of the contract."""
    model = train(documents.where(~held_out()), **options)
    docs = documents.select("doc_id", "text", held_out().alias("held_out"))
    found = identify(docs, model)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", out.alias("held_out"), F.col("lang").alias("lang_pred"), "score", "bits_per_byte")


def keep_identified(documents: DataFrame, model: Model, *, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """`documents` without texts of no language, or of a language that scores under `least`; columns unchanged."""
    letters = np.zeros(256, bool)
    letters[0x41:0x5B] = letters[0x61:0x7B] = True
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(text_col))
            keep = np.zeros(batch.num_rows, bool)
            for i, j in spans(offsets, CHUNK):
                langs, scores, _ = classify(shared.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], letters)
                keep[i:j] = (np.array(langs, object) != "und") & (scores >= least)
            yield batch.filter(pa.array(keep))
        release()

    return documents.mapInArrow(run, documents.schema)
