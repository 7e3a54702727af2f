"""JSON5-style configuration files, deep merging and expansion."""

from __future__ import annotations

import json
import re
from typing import Any

#: A token: blanks or a comment, a string, a number, a name, or a sign.
_TOKEN = re.compile(
    r"""(?P<skip>[\s\ufeff]+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<number>[+-]?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|Infinity|NaN)(?![\w$.]))|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>[{}\[\]:,])""",
    re.S | re.X,
)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", re.S)
_ESCAPED = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}


def _string(raw: str) -> str:
    """The value of a quoted string: a broken line goes on, an unknown escape is its character."""
    value = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "ux" and len(m[1]) > 1 else _ESCAPED.get(m[1], m[1]), raw[1:-1])
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(raw: str) -> str:
    body = raw.lstrip("+-")
    if body[:2] in ("0x", "0X"):
        body = str(int(body, 16))
    elif body[0].isdigit() or body[0] == ".":
        whole, e, power = body.partition("e") if "e" in body else body.partition("E")
        body = re.sub(r"^0+(?=\d)", "", "0" + whole) + ("0" if whole.endswith(".") else "") + e + power
    return "-" * (raw[0] == "-" and body != "NaN") + body


def parse(text: str) -> Any:
    """JSON5: comments, trailing commas, bare keys, single quotes, and numbers in hexadecimal, with a plus, with a bare point, Infinity and NaN."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not JSON5 at {at}: {text[at : at + 20]!r}")
        if m.lastgroup != "skip":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    out = []
    for (kind, raw), (_, after) in zip(tokens, [*tokens[1:], ("", "")], strict=True):
        if kind == "string":
            raw = json.dumps(_string(raw))
        elif after == ":" and kind in ("name", "number"):
            raw = json.dumps(raw)
        elif kind == "number":
            raw = _number(raw)
        elif raw == "," and after in ("}", "]") and out and out[-1] not in ("{", "[", ","):
            continue  # a trailing comma
        out.append(raw)
    return json.loads("".join(out))


def merge(a: Any, b: Any) -> Any:
    """Deep: b wins, but None leaves a."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a.get(k), b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    return a if b is None else b


def expand(config: dict, keys: tuple[str, ...]) -> list[dict]:
    """One config for each position of the listed keys' lists; lists have one length, or 1 and then repeat."""
    lists = {k: config[k] if isinstance(config.get(k), list) else [config.get(k)] for k in keys}
    n = max((len(v) for v in lists.values()), default=1)
    if any(len(v) not in (1, n) for v in lists.values()):
        raise ValueError(f"lists of {sorted({len(v) for v in lists.values()})} values do not expand together")
    return [config | {k: v[i % len(v)] for k, v in lists.items()} for i in range(n)]


def flatten(config: dict) -> dict[str, Any]:
    """Two levels of nesting as 'a/b'."""
    out = {}
    for k, v in config.items():
        out |= {f"{k}/{x}": y for x, y in v.items()} if isinstance(v, dict) else {k: v}
    return out
