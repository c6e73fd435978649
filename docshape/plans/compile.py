"""Rules over typed columns as plain Column expressions.

What this can express runs inside Catalyst: it is generated code, and comparisons of top-level columns
reach the Parquet scan.  Anything else raises NotCompilable, and ``matches`` then takes the walker.

A SQL NULL in a struct field stands for an absent member (``null_means="absent"``, the default) or
for null.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..interp.controls import python_pattern
from ..interp.walk import EPSILON, Abort, Index, Options, Walker, bounds
from ..operators.validate import CDDL, is_valid
from ..syntax import ast

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)


class NotCompilable(Exception):
    """What a Column can't express."""


class _Compiler:
    def __init__(self, index: Index, null_means: str):
        self.index, self.null = index, null_means
        self.walker = Walker(index, "cbor", Options(), False)  # resolves literals and names
        self.depth = 0

    def type(self, node: ast.Type, c: Column, kind: T.DataType, scope) -> Column:
        return reduce(or_, [self.type1(x, c, kind, scope) for x in node.choices])

    def type1(self, node: ast.Type1, c: Column, kind: T.DataType, scope) -> Column:
        match node.op:
            case None:
                return self.type2(node.base, c, kind, scope)
            case ast.Range():
                low, high, inclusive = self.walker.limits(node, scope)
                if not isinstance(kind, _INTS if low.kind == "int" else _FLOATS):
                    return F.lit(False)
                top = c <= high.value if inclusive else c < high.value
                ok = (c >= low.value) & top
                return ok & ~F.isnan(c) if isinstance(kind, _FLOATS) else ok
        return self.control(node, c, kind, scope)

    def control(self, node: ast.Type1, c: Column, kind: T.DataType, scope) -> Column:
        name, operand = node.op.name, node.op.operand
        if name in ("cat", "det", "plus"):
            return self.type(ast.Type([ast.Type1(v) for v in self.walker.literals(node, scope)]), c, kind, scope)
        target = self.type2(node.base, c, kind, scope)
        if name == "default":
            return target
        if name in ("and", "within", "eq"):
            return target & self.type2(operand, c, kind, scope)
        if name == "ne":
            return target & ~self.type2(operand, c, kind, scope)
        literals = self.walker.literals(operand, scope)
        if name in ("lt", "le", "gt", "ge") and literals and literals[0].kind in ("int", "float") and isinstance(kind, _INTS + _FLOATS):
            limit = literals[0].value
            ok = {"lt": c < limit, "le": c <= limit, "gt": c > limit, "ge": c >= limit}[name]
            return target & (ok & ~F.isnan(c) if isinstance(kind, _FLOATS) else ok)
        if name == "size":
            return target & self.size(operand, literals, c, kind, scope)
        if name == "bits" and literals and all(v.kind == "int" and v.value >= 0 for v in literals) and isinstance(kind, _INTS):
            mask = sum({1 << v.value for v in literals if v.value < 63})
            return target & (c >= 0) & (c.cast("long").bitwiseAND(F.lit(~mask)) == 0)
        if name in ("regexp", "pcre", "iregexp") and literals and literals[0].kind == "text" and isinstance(kind, T.StringType):
            pattern = literals[0].value
            if not _portable(pattern):
                raise NotCompilable(f"the pattern {pattern!r}")
            own = python_pattern(pattern, name).replace(r"\Z", r"\z")
            return target & c.rlike(f"(?d){own}" if name == "regexp" else rf"(?d)\A(?:{own})\z")
        raise NotCompilable(f".{name}")

    def size(self, operand: ast.Node, literals, c: Column, kind: T.DataType, scope) -> Column:
        from ..interp.controls import _range

        span = _range(self.walker, operand, scope)
        if span is not None:
            low, high, inclusive = self.walker.limits(span, scope)
            first, last = low.value, high.value if inclusive else high.value - 1
        elif literals and len(literals) == 1 and literals[0].kind == "int":
            first = last = literals[0].value
        else:
            raise NotCompilable(".size of this")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(c).between(first, last)
        if isinstance(kind, _INTS):
            return (c >= 0) & (F.lit(last >= 8) | (c < F.lit(256 ** min(max(last, 0), 7))))
        return F.lit(False)

    def type2(self, node: ast.Node, c: Column, kind: T.DataType, scope) -> Column:
        match node:
            case ast.Value():
                return self.literal(node, c, kind)
            case ast.Paren(inner):
                return self.type(inner, c, kind, scope)
            case ast.AnyItem():
                return F.lit(True)
            case ast.Name():
                return self.name(node, c, kind, scope)
            case ast.EnumGroup() | ast.EnumName():
                found = self.walker.literals(node, scope)
                if not found:
                    raise NotCompilable("an enumeration of types")
                return reduce(or_, [self.literal(v, c, kind) for v in found])
            case ast.Array(group):
                return self.array(group, c, kind, scope)
            case ast.Map(group):
                return self.map(group, c, kind, scope)
        raise NotCompilable(type(node).__name__)

    def literal(self, node: ast.Value, c: Column, kind: T.DataType) -> Column:
        if node.kind == "int" and isinstance(kind, _INTS):
            return c == node.value if -(1 << 63) <= node.value < 1 << 63 else F.lit(False)
        if node.kind == "float" and isinstance(kind, _FLOATS):
            return ~F.isnan(c) & ((c == node.value) | (F.abs(c - node.value) < EPSILON))
        if node.kind == "text" and isinstance(kind, T.StringType) or node.kind == "bytes" and isinstance(kind, T.BinaryType):
            return c == F.lit(node.value)
        return F.lit(False)

    def name(self, node: ast.Name, c: Column, kind: T.DataType, scope) -> Column:
        if (found := self.walker.bound(node, scope)) is not None:
            return self.type1(found[0], c, kind, found[1])
        rules = self.index.types.get(node.key)
        if rules:
            self.depth += 1
            if self.depth > 64:
                raise NotCompilable(f"{node.key} refers to itself")
            try:
                return reduce(or_, [self.type(r.type, c, kind, self.walker.scope_of(r, node, scope)) for r in rules])
            finally:
                self.depth -= 1
        if node.key in self.index.groups or node.ident not in ast.PRELUDE or node.socket:
            raise NotCompilable(node.key)
        whole, real = isinstance(kind, _INTS), isinstance(kind, _FLOATS)
        match node.ident:
            case "any":
                return F.lit(True)
            case "uint" | "unsigned":
                return c >= 0 if whole else F.lit(False)
            case "nint":
                return c < 0 if whole else F.lit(False)
            case "int" | "integer":
                return F.lit(whole)
            case "number":
                return F.lit(whole or real)
            case "float" | "float16" | "float32" | "float64" | "float16-32" | "float32-64":
                return F.lit(real)
            case "tstr" | "text":
                return F.lit(isinstance(kind, T.StringType))
            case "bstr" | "bytes":
                return F.lit(isinstance(kind, T.BinaryType))
            case "bool":
                return F.lit(isinstance(kind, T.BooleanType))
            case "true" | "false":
                return c == F.lit(node.ident == "true") if isinstance(kind, T.BooleanType) else F.lit(False)
            case "null" | "nil":
                return F.lit(False)  # a present value; absent ones are handled with their member
        raise NotCompilable(node.ident)

    def present(self, c: Column, node: ast.Type, kind: T.DataType, scope) -> Column:
        """A value's test that is never NULL."""
        ok = F.coalesce(self.type(node, c, kind, scope), F.lit(False))
        if self.null == "null" and any(isinstance(x.base, ast.Name) and x.base.ident in ("null", "nil", "any") for x in node.choices if x.op is None):
            return c.isNull() | ok
        return c.isNotNull() & ok

    def array(self, group: ast.Group, c: Column, kind: T.DataType, scope) -> Column:
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        out = []
        for choice in group.choices or [[]]:
            if any(e.group is not None or _spliced(self, e) for e in choice):
                raise NotCompilable("a group inside an array")
            *head, last = choice or [None]
            if any(e.occur is not None for e in head):
                raise NotCompilable("a repetition before the end of an array")
            tests = [self.present(F.get(c, F.lit(k)), e.type, kind.elementType, scope) for k, e in enumerate(head)]
            if last is None:
                tests.append(F.size(c) == 0)
            elif last.occur is None:
                tests += [F.size(c) == len(choice), self.present(F.get(c, F.lit(len(head))), last.type, kind.elementType, scope)]
            else:
                low, high = bounds(last.occur)
                tests.append(F.size(c) >= len(head) + low)
                if high != math.inf:
                    tests.append(F.size(c) <= len(head) + int(high))
                rest = F.slice(c, len(head) + 1, F.greatest(F.size(c) - len(head), F.lit(0))) if head else c
                tests.append(F.forall(rest, lambda x: self.present(x, last.type, kind.elementType, scope)))
            out.append(reduce(and_, tests))
        return reduce(or_, out)

    def map(self, group: ast.Group, c: Column, kind: T.DataType, scope) -> Column:
        if not isinstance(kind, T.StructType):
            return F.lit(False)
        fields = {f.name: f.dataType for f in kind.fields}
        out = []
        for choice in group.choices or [[]]:
            tests, seen = [], set()
            for e in choice:
                key = e.key.word if e.key and e.key.word is not None else e.key.value.value if e.key and e.key.value else None
                if key is None and e.key and e.key.type and e.key.type.op is None and isinstance(e.key.type.base, ast.Value):
                    key = e.key.type.base.value
                low, high = bounds(e.occur)
                if not isinstance(key, str) or high > 1 or key in seen:
                    raise NotCompilable("a member without a literal key of its own")
                seen.add(key)
                if key not in fields:
                    tests.append(F.lit(low == 0))
                    continue
                own = c.getField(key)
                ok = self.present(own, e.type, fields[key], scope)
                tests.append(own.isNull() | ok if low == 0 and self.null == "absent" else ok)
            left = [c.getField(n) for n in fields if n not in seen]
            tests += [x.isNull() for x in left] if self.null == "absent" else [F.lit(False) for _ in left]
            out.append(reduce(and_, tests, F.lit(True)))
        return reduce(or_, out)


def _spliced(compiler: _Compiler, entry: ast.Entry) -> bool:
    only = entry.type.choices[0] if entry.type and len(entry.type.choices) == 1 else None
    return only is not None and only.op is None and (isinstance(only.base, ast.Unwrap) or isinstance(only.base, ast.Name) and compiler.walker.group_of(only.base, {}) is not None)


def _portable(pattern: str) -> bool:
    """Whether Java and Python surely read a pattern alike: letters, classes, simple repetition."""
    import re

    return re.fullmatch(r"(?:[A-Za-z0-9 _:/@,;=#%&!~'\"<>-]|\\[.\\()\[\]{}*+?|^$/-]|\[\^?(?:[A-Za-z0-9 _.:/@,;=#-]|[A-Za-z0-9]-[A-Za-z0-9])+\]|[().*+?|^$]|\{\d+(?:,\d*)?\})*", pattern, re.A) is not None


def compile_rule(schema: CDDL | str, column: str | Column, kind: T.DataType, *, rule: str | None = None, null_means: str = "absent") -> Column:
    """A boolean Column: whether values of a typed column match a rule.  Raises NotCompilable."""
    own = schema if isinstance(schema, CDDL) else CDDL(schema)
    root = own.root(rule)
    c = F.col(column) if isinstance(column, str) else column
    try:
        test = _Compiler(Index(own.tree), null_means).name(ast.Name(root.lstrip("$"), root[: len(root) - len(root.lstrip("$"))]), c, kind, {})
    except Abort as e:
        raise NotCompilable(e.reason) from None
    return F.when(c.isNotNull(), F.coalesce(test, F.lit(False)))


def matches(df: DataFrame, schema: CDDL | str, column: str, *, rule: str | None = None) -> tuple[Column, str]:
    """A Column that tells whether values match, and its tier.

    catalyst: a plain expression.  arrow: the walker, over values encoded as CBOR, null fields left
    out.
    """
    kind = df.schema[column].dataType
    try:
        return compile_rule(schema, column, kind, rule=rule), "catalyst"
    except NotCompilable:
        from ..functions.codecs import cbor_encode_present

        return F.when(F.col(column).isNotNull(), is_valid(schema, cbor_encode_present(F.col(column)), rule=rule, model="cbor")), "arrow"
