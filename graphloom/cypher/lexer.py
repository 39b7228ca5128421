"""Text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from .syntax import CypherSyntaxError, Pos


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, int, float, string, param, sign, end
    value: Any
    at: Pos

    def word(self) -> str:
        return self.value.upper() if self.kind == "name" else ""


_TOKEN = re.compile(
    r"""
    (?P<blank>\s+|//[^\n]*|/\*.*?\*/)
  | (?P<float>(?:\d+\.(?!\.)\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?))
  | (?P<int>\d+)
  | (?P<name>[^\W\d]\w*)
  | `(?P<quoted>[^`]+)`
  | \$(?P<param>\w+)
  | (?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
  | (?P<sign><>|<=|>=|=~|\+=|\.\.|[-+*/%=<>()\[\]{},.:|;])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "0": "\0"}


def _unquote(raw: str, at: Pos) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in _ESCAPES:
            raise CypherSyntaxError(f"unknown escape \\{m[1]}", at)
        return _ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, raw[1:-1], flags=re.DOTALL)


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    i, line, start = 0, 1, 0
    while i < len(text):
        at = (line, i - start + 1)
        m = _TOKEN.match(text, i)
        if m is None:
            what = "unterminated string" if text[i] in "'\"" else "unterminated comment" if text.startswith("/*", i) else f"unexpected character {text[i]!r}"
            raise CypherSyntaxError(what, at)
        kind, raw = m.lastgroup, m[0]
        if kind == "int":
            if (n := int(raw)) > 2**63 - 1:
                raise CypherSyntaxError(f"integer {raw} is out of range", at)
            out.append(Token("int", n, at))
        elif kind == "float":
            out.append(Token("float", float(raw), at))
        elif kind == "string":
            out.append(Token("string", _unquote(raw, at), at))
        elif kind != "blank":
            out.append(Token(kind, m[kind], at))
        line += raw.count("\n")
        if "\n" in raw:
            start = i + raw.rindex("\n") + 1
        i = m.end()
    out.append(Token("end", None, (line, i - start + 1)))
    return out
