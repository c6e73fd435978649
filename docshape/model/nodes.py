"""One item of a document, of either model."""

from __future__ import annotations

import math
import struct
from typing import Any


class Item:
    """``kind`` is int, float, text, bytes, array, map, tag, bool, null, undefined or simple.

    ``value`` is the Python value: a list of items for an array, a list of pairs of items for a
    map (in order, repeated keys kept), the content for a tag.  ``extra`` is a tag's number or a
    float's width in bytes.  ``indefinite`` items were encoded without a length; a string's ``chunks``
    are then its parts.
    """

    __slots__ = ("chunks", "extra", "indefinite", "kind", "text", "value")

    def __init__(self, kind: str, value: Any = None, extra: int | None = None, indefinite: bool = False, text: str | None = None, chunks: list | None = None):
        self.kind, self.value, self.extra, self.indefinite, self.text, self.chunks = kind, value, extra, indefinite, text, chunks

    def __repr__(self) -> str:
        return f"Item({render(self)})"

    @property
    def bignum(self) -> int | None:
        """The integer that a tag 2 or 3 over bytes stands for."""
        if self.kind == "tag" and self.extra in (2, 3) and self.value.kind == "bytes":
            n = int.from_bytes(self.value.value, "big")
            return n if self.extra == 2 else -1 - n
        return None


def equal(a: Item, b: Item) -> bool:
    """Equality of values: widths and lengths don't count, NaN equals nothing, null equals undefined."""
    none = ("null", "undefined")
    if a.kind in none or b.kind in none:
        return a.kind in none and b.kind in none
    if a.kind != b.kind:
        return False
    if a.kind == "array":
        return len(a.value) == len(b.value) and all(map(equal, a.value, b.value))
    if a.kind == "map":
        return len(a.value) == len(b.value) and all(equal(p, r) and equal(q, s) for (p, q), (r, s) in zip(a.value, b.value))
    if a.kind == "tag":
        return a.extra == b.extra and equal(a.value, b.value)
    return a.value == b.value


def identical(a: Item, b: Item) -> bool:
    """Structural equality: widths and lengths count, NaN equals NaN."""
    if (a.kind, a.extra, a.indefinite) != (b.kind, b.extra, b.indefinite):
        return False
    if a.kind == "array":
        return len(a.value) == len(b.value) and all(map(identical, a.value, b.value))
    if a.kind == "map":
        return len(a.value) == len(b.value) and all(identical(p, r) and identical(q, s) for (p, q), (r, s) in zip(a.value, b.value))
    if a.kind == "tag":
        return identical(a.value, b.value)
    if a.kind == "float":
        return struct.pack(">d", a.value) == struct.pack(">d", b.value) or math.isnan(a.value) and math.isnan(b.value)
    return a.value == b.value


def _cut(text: str, limit: int) -> str:
    return text if len(text) <= limit else text[: limit - 3] + "..."


def render(item: Item, limit: int = 256, depth: int = 8) -> str:
    """An item for messages, bounded in length and depth."""
    match item.kind:
        case "text":
            out = '"' + item.value.replace("\\", "\\\\").replace('"', '\\"') + '"'
        case "bytes":
            out = f"h'{item.value[:limit].hex()}'"
        case "array":
            out = "[...]" if depth == 0 else "[" + ", ".join(render(x, limit, depth - 1) for x in item.value[:16]) + (", ..." if len(item.value) > 16 else "") + "]"
        case "map":
            parts = [f"{render(k, limit, depth - 1)}: {render(v, limit, depth - 1)}" for k, v in item.value[:16]] if depth else ["..."]
            out = "{" + ", ".join(parts) + (", ..." if len(item.value) > 16 else "") + "}"
        case "tag":
            out = f"{item.extra}({render(item.value, limit, depth - 1) if depth else '...'})"
        case "bool":
            out = "true" if item.value else "false"
        case "null" | "undefined":
            out = item.kind
        case "simple":
            out = f"simple({item.value})"
        case "float":
            out = item.text or repr(item.value)
        case _:
            out = str(item.value)
    return _cut(out, limit)


def path_key(item: Item, model: str) -> str:
    """A map key as a step of a path: JSON names as they are, CBOR keys as literals."""
    return item.value if model == "json" else render(item)
