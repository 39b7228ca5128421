"""Chat formatting in budgeted windows (operator 5).

Prefix sums of the turns' tokens cut a conversation into spans of whole turns.
Each span becomes a window: the leading system turn, a limited history (the
last turns before the span), and the span.  Only assistant texts of the span
are targets; what a window repeats is masked.  So every turn is new in one
window exactly, and every target is learnt once.

Turns are marked by control strings.  Inside texts and roles a backslash breaks
every control string, and backslashes double, so formatting can be undone.

A task reads its conversations turn by turn, in order, and holds one window and
its history at most, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import tokenizer_path, tokens_of

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: Strings that no text may show to a model unbroken: this template's, and those of common other ones.
CONTROLS = (OPEN, CLOSE, "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>")


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, str, str]:
    """Header, escaped text and end of a turn."""
    return f"{OPEN}{escape(role)}{CLOSE}\n", escape(text), f"{END}\n"


_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.DOTALL)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a window; begin and end bound the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(window)]


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


def windows(turns: Iterator[Turn], budget: int, history_turns: int, history_tokens: int, target: str = "assistant") -> Iterator[tuple[str, int, int, list[tuple[int, int]], int]]:
    """(text, repeated turns, new turns, loss spans, tokens) of each window of a conversation."""
    system: Turn | None = None
    past: deque[Turn] = deque(maxlen=history_turns)
    span: list[Turn] = []
    context: list[Turn] = []
    total = begin = 0  # the prefix sum of all turns so far, and where the span begins
    room = budget

    def close():
        parts, at, loss = [], 0, []
        for i, t in enumerate([*context, *span]):
            head, body, end = render(t.role, t.text)
            if i >= len(context) and t.role == target:
                loss.append((at + len(head), at + len(head) + len(body)))
            parts += [head, body, end]
            at += len(head) + len(body) + len(end)
        return "".join(parts), len(context), len(span), loss, sum(t.tokens for t in context) + total - begin

    first = True
    for t in turns:
        if span and total + t.tokens - begin > room:
            yield close()
            past.extend(span)
            span, begin = [], total
        if not span:
            context = [system] if system else []
            room = budget - sum(x.tokens for x in context)
            back: list[Turn] = []
            used = 0
            for x in reversed(past):
                if x is system or used + x.tokens > history_tokens or used + x.tokens + t.tokens > room:
                    break
                back.append(x)
                used += x.tokens
            context += back[::-1]
            room -= used
        span.append(t)
        total += t.tokens
        if first and t.role == "system":
            system = t
        first = False
    if span:
        yield close()


WINDOWS = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int64()), ("new_turns", pa.int64()), ("loss", pa.list_(pa.list_(pa.int64()))), ("n_tokens", pa.int64())])
WINDOWS_SQL = "conv_id long, window long, text string, repeated long, new_turns long, loss array<array<long>>, n_tokens long"


def _format(path: str, budget: int, history_turns: int, history_tokens: int):
    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turn]]:
        tokens = tokens_of(path)
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for lo in range(0, len(roles), 512):
                shown = ["".join(render(r, t)).encode() for r, t in zip(roles[lo : lo + 512], texts[lo : lo + 512])]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in shown])))
                _, at = tokens.encode(np.frombuffer(b"".join(shown), np.uint8), offsets)
                for i, n in enumerate(np.diff(at).tolist()):
                    yield batch.column("conv_id")[lo + i].as_py(), Turn(roles[lo + i], texts[lo + i], n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        source = turns(batches)
        head = next(source, None)

        def same(conv) -> Iterator[Turn]:
            nonlocal head
            while head is not None and head[0] == conv:
                yield head[1]
                head = next(source, None)

        while head is not None:
            conv = head[0]
            for n, w in enumerate(windows(same(conv), budget, history_turns, history_tokens)):
                rows.append((conv, n, *w))
                size += len(w[0])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), WINDOWS)], schema=WINDOWS)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), WINDOWS)], schema=WINDOWS)

    return run


def format_conversations(conversations: DataFrame, *, budget: int = 1024, history_turns: int = 4, history_tokens: int = 256, tokenizer: str | None = None) -> DataFrame:
    """One row (conv_id, window, text, repeated, new_turns, loss, n_tokens) for each window, a conversation's windows in order.

    budget: tokens of a window; a turn that is longer on its own, beside the
    system turn, has a window for itself that exceeds it (turns are never
    cut).  history_turns and history_tokens limit what a window repeats beside
    the system turn.  repeated: how many turns of the text are repeated; the
    new_turns others follow them.  loss: begin and end of each target, in code
    points of the text.  Turns come by turn, ties by role and text; equal rows
    are turns of their own.  A null text or role is empty, a null turn comes
    first, and rows with a null conv_id are one conversation.  Other columns
    are not read.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(tokenizer or tokenizer_path(), budget, history_turns, history_tokens), WINDOWS_SQL)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
    rows: list[tuple] = []
    now = None
    for batch in batches:
        for w in batch.to_pylist():
            if now is None or w["conv_id"] != now[0]:
                if now is not None:
                    rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))
                now = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text, _, _ in parse(w["text"])[w["repeated"] :]:
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            for a, b in w["loss"]:
                text = unescape(w["text"][a:b])
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(w["text"])
            now[6] += 1
        if len(rows) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
            rows = []
    if now is not None:
        rows.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def chat_report(conversations: DataFrame, **options) -> DataFrame:
    """The columns of the contract, read back from the windows' texts in the tasks that made them."""
    made = format_conversations(conversations, **options)
    return made.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


#: A conversation that speaks in another template's control strings.
TRICK = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
