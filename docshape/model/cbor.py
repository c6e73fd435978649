"""CBOR (RFC 8949) to items and back, without recursion; with spans and encoding flags on request."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

from .nodes import Item

MAX_DEPTH = 65_536
#: Flag bits of an annotated item.
OVERLONG, INDEFINITE, WIDE_FLOAT, UNSORTED, DUPLICATES, DUPLICATE = (1 << k for k in range(6))
_HEADS = {24: (1, 24), 25: (2, 1 << 8), 26: (4, 1 << 16), 27: (8, 1 << 32)}


class CBORError(ValueError):
    """Why the bytes aren't one item, and the offset of that."""

    def __init__(self, offset: int, reason: str):
        self.offset, self.reason = offset, reason
        super().__init__(f"byte {offset}: {reason}")


@dataclass
class Span:
    """An annotated item: its bytes are ``start`` to ``end``, its head ends at ``header_end``."""

    start: int
    item: Item | None
    header_end: int = 0
    end: int = 0
    flags: int = 0
    complete: bool = True
    children: list[Span] = field(default_factory=list)  # a map's keys and values in turn


class _Open:
    __slots__ = ("item", "left", "parts", "span")

    def __init__(self, item: Item, left: int | None, span: Span | None):
        self.item, self.left, self.span, self.parts = item, left, span, []


def _shortest(value: float) -> int:
    if math.isnan(value):
        return 2
    for width, code in ((2, ">e"), (4, ">f")):
        try:
            if struct.unpack(code, struct.pack(code, value))[0] == value:
                return width
        except (OverflowError, struct.error):
            pass
    return 8


def _close(frame: _Open, data: bytes, end: int) -> Item:
    """A container or chunked string whose parts are all there."""
    item, parts, span = frame.item, frame.parts, frame.span
    if span:
        span.end = end
    if item.kind in ("bytes", "text"):
        joined = b"".join(p.value if item.kind == "bytes" else p.value.encode() for p in parts)
        item.value, item.chunks = (joined if item.kind == "bytes" else joined.decode()), [p.value for p in parts]
    elif item.kind == "tag":
        item.value = parts[0]
    elif item.kind == "array":
        item.value = parts
    else:
        item.value = list(zip(parts[::2], parts[1::2]))
        if span:
            keys = [data[c.start : c.end] for c in span.children[::2]]
            if any(a > b for a, b in zip(keys, keys[1:])):
                span.flags |= UNSORTED
            seen: set[bytes] = set()
            for key, child in zip(keys, span.children[::2]):
                if key in seen:
                    child.flags |= DUPLICATE
                    span.flags |= DUPLICATES
                seen.add(key)
    return item


def _decode(data: bytes, start: int, roots: list[Span] | None, stack: list[_Open]) -> tuple[Item, int]:
    """The item at ``start`` and its end.  Spans go to ``roots`` if that is given; what is open when an
    error is raised is left on ``stack``."""
    pos, n, annotated = start, len(data), roots is not None
    while True:
        at = pos
        if pos >= n:
            raise CBORError(pos, "the input ends early")
        first = data[pos]
        major, low = first >> 5, first & 31
        pos += 1
        flags, value = 0, low
        if low in _HEADS:
            width, least = _HEADS[low]
            if pos + width > n:
                raise CBORError(at, "the input ends early")
            value = int.from_bytes(data[pos : pos + width], "big")
            pos += width
            if value < least and major != 7:
                flags |= OVERLONG
        elif 28 <= low <= 30 or low == 31 and major in (0, 1, 6):
            raise CBORError(at, f"additional information {low}")
        indefinite = low == 31
        span = Span(at, None, pos, pos, flags) if annotated else None
        outer = stack[-1] if stack else None
        if first == 0xFF:
            if not outer or outer.left is not None or outer.item.kind == "map" and len(outer.parts) % 2:
                raise CBORError(at, "unexpected break")
            item = _close(stack.pop(), data, pos)
            span = None
        else:
            if span:
                if indefinite:
                    span.flags |= INDEFINITE
                (outer.span.children if outer else roots).append(span)
            in_chunks = outer is not None and outer.item.kind in ("bytes", "text")
            if in_chunks and (indefinite or major != (2 if outer.item.kind == "bytes" else 3)):
                raise CBORError(at, "a chunk of another type")
            if major == 0:
                item = Item("int", value)
            elif major == 1:
                item = Item("int", -1 - value)
            elif major in (2, 3) and not indefinite:
                if pos + value > n:
                    raise CBORError(at, "the input ends early")
                raw = data[pos : pos + value]
                pos += value
                try:
                    item = Item("bytes", raw) if major == 2 else Item("text", raw.decode("utf-8"))
                except UnicodeDecodeError:
                    raise CBORError(at, "text that isn't UTF-8") from None
            elif major == 7:
                if low == 24 and value < 32:
                    raise CBORError(at, f"simple value {value} in two bytes")
                if low in (25, 26, 27):
                    width = 1 << (low - 24)
                    number = struct.unpack({2: ">e", 4: ">f", 8: ">d"}[width], data[pos - width : pos])[0]
                    item = Item("float", number, width)
                    if span and _shortest(number) < width:
                        span.flags |= WIDE_FLOAT
                else:
                    item = {20: Item("bool", False), 21: Item("bool", True), 22: Item("null"), 23: Item("undefined")}.get(value) or Item("simple", value)
            else:
                kind = {2: "bytes", 3: "text", 4: "array", 5: "map", 6: "tag"}[major]
                left = None if indefinite else {4: value, 5: 2 * value, 6: 1}.get(major)
                if left is not None and left > n - pos and not annotated:
                    raise CBORError(at, "the input ends early")
                if len(stack) >= MAX_DEPTH:
                    raise CBORError(at, "nested too deeply")
                item = Item(kind, [], value if major == 6 else None, indefinite)
                if span:
                    span.item = item
                frame = _Open(item, left, span)
                if left != 0:
                    stack.append(frame)
                    continue
                _close(frame, data, pos)
            if span:
                span.item, span.end = item, pos
        # the item is complete
        while True:
            if not stack:
                return item, pos
            frame = stack[-1]
            frame.parts.append(item)
            if frame.left is None or len(frame.parts) < frame.left:
                break
            item = _close(stack.pop(), data, pos)


def decode_prefix(data: bytes, start: int = 0) -> tuple[Item, int]:
    """The item at ``start`` and where it ends."""
    return _decode(data, start, None, [])


def decode(data: bytes) -> Item:
    """Exactly one item."""
    item, end = decode_prefix(data)
    if end < len(data):
        raise CBORError(end, f"{len(data) - end} bytes after the item")
    return item


def decode_sequence(data: bytes) -> list[Item]:
    """The items of a CBOR sequence (RFC 8742)."""
    out, pos = [], 0
    while pos < len(data):
        item, pos = decode_prefix(data, pos)
        out.append(item)
    return out


def decode_annotated(data: bytes) -> tuple[Span | None, CBORError | None]:
    """The item with spans and flags, as far as the bytes go, and what ended it; never raises.

    Items that the input cuts off are incomplete and end where the input does.
    """
    roots: list[Span] = []
    stack: list[_Open] = []
    error = None
    try:
        _, end = _decode(data, 0, roots, stack)
        if end < len(data):
            error = CBORError(end, f"{len(data) - end} bytes after the item")
    except CBORError as e:
        error = e
        last = (stack[-1].span.children if stack else roots)[-1:]
        for span in [f.span for f in stack] + [x for x in last if x.item is None]:
            span.complete, span.end = False, len(data)
    return (roots[0] if roots else None), error


def head(major: int, value: int) -> bytes:
    if value < 24:
        return bytes([major << 5 | value])
    for low, (width, _) in _HEADS.items():
        if value < 1 << (8 * width):
            return bytes([major << 5 | low]) + value.to_bytes(width, "big")
    raise ValueError(f"{value} doesn't fit a head")


def encode(item: Item) -> bytes:
    """Shortest heads; floats in their width; what was indefinite stays so."""
    out: list[bytes] = []
    stack: list = [item]
    while stack:
        one = stack.pop()
        if isinstance(one, bytes):
            out.append(one)
            continue
        kind, value = one.kind, one.value
        if kind == "int":
            out.append(head(0, value) if value >= 0 else head(1, -1 - value))
        elif kind in ("bytes", "text"):
            major = 2 if kind == "bytes" else 3
            raw = [value if kind == "bytes" else value.encode()] if not one.indefinite else [c if kind == "bytes" else c.encode() for c in (one.chunks if one.chunks is not None else [value])]
            body = b"".join(head(major, len(r)) + r for r in raw)
            out.append(bytes([major << 5 | 31]) + body + b"\xff" if one.indefinite else body)
        elif kind in ("array", "map"):
            major = 4 if kind == "array" else 5
            out.append(bytes([major << 5 | 31]) if one.indefinite else head(major, len(value)))
            if one.indefinite:
                stack.append(b"\xff")
            stack.extend(reversed(value if kind == "array" else [x for pair in value for x in pair]))
        elif kind == "tag":
            out.append(head(6, one.extra))
            stack.append(value)
        elif kind == "float":
            width = one.extra or 8
            out.append(bytes([0xE0 | 24 + width.bit_length() - 1]) + struct.pack({2: ">e", 4: ">f", 8: ">d"}[width], value))
        elif kind == "simple":
            out.append(bytes([0xE0 | value]) if value < 24 else bytes([0xF8, value]))
        else:
            out.append({"null": b"\xf6", "undefined": b"\xf7"}.get(kind) or (b"\xf5" if value else b"\xf4"))
    return b"".join(out)


def item_of(value) -> Item:
    """A plain Python value as an item: dictionaries are maps, floats take their shortest width."""
    match value:
        case Item():
            return value
        case None:
            return Item("null")
        case bool():
            return Item("bool", value)
        case int():
            if -(1 << 64) <= value < 1 << 64:
                return Item("int", value)
            magnitude = value if value >= 0 else -1 - value
            return Item("tag", Item("bytes", magnitude.to_bytes((magnitude.bit_length() + 7) // 8, "big")), 2 if value >= 0 else 3)
        case float():
            return Item("float", value, _shortest(value))
        case str():
            return Item("text", value)
        case bytes() | bytearray():
            return Item("bytes", bytes(value))
        case dict():
            return Item("map", [(item_of(k), item_of(v)) for k, v in value.items()])
        case list() | tuple():
            return Item("array", [item_of(v) for v in value])
    raise TypeError(type(value).__name__)
