"""A tolerant reader for import documents, and their timestamps."""

from __future__ import annotations

import re
from datetime import datetime, timezone

_TOKEN = re.compile(r"""\s*(?:(?P<mark>[{}\[\]:,])|"(?P<text>(?:[^"\\]|\\.)*)"|(?P<bare>[^\s{}\[\]:,"]+))""")
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unreadable import at character {at}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "text":
            value = re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda e: chr(int(e[1], 16)) if e[1] else _ESCAPE.get(e[2], e[2]), value)
        out.append((kind, value))
        at = m.end()
    return out


def _scalar(word: str) -> object:
    if word in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[word]
    for read in (int, float):
        try:
            return read(word)
        except ValueError:
            pass
    return word


def parse_lenient(text: str) -> object:
    """JSON in which keys and words need no quotes and commas may be missing."""
    tokens = _tokens(text)
    at = 0

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def take() -> tuple[str, str]:
        nonlocal at
        token = peek()
        if token[0] == "end":
            raise ValueError("the import ends too early")
        at += 1
        return token

    def skip_commas() -> None:
        while peek() == ("mark", ","):
            take()

    def value() -> object:
        kind, word = take()
        if kind == "text":
            return word
        if kind == "bare":
            return _scalar(word)
        if word == "{":
            found: dict = {}
            skip_commas()
            while peek() != ("mark", "}"):
                key = take()
                if key[0] == "mark" or take() != ("mark", ":"):
                    raise ValueError(f"expected a key and a colon near {key[1]!r}")
                found[key[1]] = value()
                skip_commas()
            take()
            return found
        if word == "[":
            items = []
            skip_commas()
            while peek() != ("mark", "]"):
                items.append(value())
                skip_commas()
            take()
            return items
        raise ValueError(f"unexpected {word!r}")

    result = value()
    if peek()[0] != "end":
        raise ValueError(f"unexpected {peek()[1]!r} after the import")
    return result


def parse_timestamp(text: str) -> int:
    """Microseconds of a time like ``2010-01-02T10:30:20Z``, in whole seconds."""
    t = datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
    d = t - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (d.days * 86_400 + d.seconds) * 1_000_000
