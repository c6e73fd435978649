"""Plain CBOR maps judged without items: true, false, or None where only the walker can tell.

For rules that are closed maps of required members with literal names, whose types are integers (perhaps
compared to a number), texts and literals.  Documents that hold just these members, in the rule's order
and with definite lengths, are judged from their bytes.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from ..model import cbor
from ..model.nodes import Item
from ..syntax import ast
from .walk import Options

Quick = Callable[[bytes], bool | None]
_COMPARED = {"lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}
#: Names and members of a longer form are the walker's.
_SHORT = 24


def _leaf(one: ast.Type1, taken: set[str]) -> Callable[[int | str], bool] | None:
    base, op = one.base, one.op
    if isinstance(base, ast.Value) and base.kind in ("int", "text") and op is None:
        return lambda v, kind=type(base.value), own=base.value: type(v) is kind and v == own
    if not isinstance(base, ast.Name) or base.socket or base.args or base.ident in taken:
        return None
    if base.ident == "tstr" and op is None:
        return lambda v: type(v) is str
    if base.ident not in ("uint", "int"):
        return None
    least = 0 if base.ident == "uint" else -(1 << 64)
    if op is None:
        return lambda v: type(v) is int and v >= least
    if isinstance(op, ast.Control) and op.name in _COMPARED and isinstance(op.operand, ast.Value) and op.operand.kind == "int":
        return lambda v, fits=_COMPARED[op.name], bound=op.operand.value: type(v) is int and v >= least and fits(v, bound)
    return None


def _value(data: bytes, at: int) -> tuple[int | str | None, int]:
    """The integer or text at ``at`` and its end; None for anything else."""
    first = data[at]
    low, at = first & 31, at + 1
    if low >= _SHORT:
        if low > 27:
            return None, at
        width = 1 << (low - 24)
        if at + width > len(data):
            return None, at
        low, at = int.from_bytes(data[at : at + width], "big"), at + width
    match first >> 5:
        case 0:
            return low, at
        case 1:
            return -1 - low, at
        case 3 if at + low <= len(data):
            try:
                return data[at : at + low].decode(), at + low
            except UnicodeDecodeError:
                return None, at
    return None, at


def compile_quick(schema: ast.Schema, root: str, options: Options) -> Quick | None:
    """The rule's test, or None if it has none."""
    rules = [r for r in schema.rules if r.name.key == root]
    taken = {r.name.key for r in schema.rules}
    if options != Options() or len(rules) != 1 or rules[0].type is None or rules[0].params or len(rules[0].type.choices) != 1:
        return None
    top = rules[0].type.choices[0]
    if not isinstance(top.base, ast.Map) or top.op is not None or len(top.base.group.choices) != 1:
        return None
    members: list[tuple[bytes, list[Callable[[int | str], bool]]]] = []
    for entry in top.base.group.choices[0]:
        key = entry.key
        if entry.occur is not None or entry.type is None or key is None or not key.cut or key.type is not None:
            return None
        name = key.word if key.word is not None else key.value.value if key.value is not None and key.value.kind == "text" else None
        leaves = [_leaf(c, taken) for c in entry.type.choices]
        if name is None or len(name.encode()) >= _SHORT or None in leaves:
            return None
        members.append((cbor.encode(Item("text", name)), leaves))
    if len({k for k, _ in members}) < len(members) or len(members) >= _SHORT:
        return None
    head = bytes([0xA0 | len(members)])

    def judged(data: bytes) -> bool | None:
        if not data.startswith(head):
            return None
        at, good = 1, True
        for key, leaves in members:
            if not data.startswith(key, at) or at + len(key) >= len(data):
                return None
            value, at = _value(data, at + len(key))
            if value is None:
                return None
            good = good and any(fits(value) for fits in leaves)
        return good if at == len(data) else None

    return judged
