"""Rules over JSON text as Column expressions, by Spark's variants.

The expression answers true, false, or NULL for "not sure"; whoever uses it gives such rows to the
walker.  Unsure are texts that the two readers of JSON might take differently (malformed ones,
repeated names, escapes by number, integers beyond 64 bits, ``-0``, infinite floats) and texts so long that
limits of work could matter.  SQL's logic of three values carries the doubt through and, or and not.

What a rule needs beyond this raises NotCompilable, and all its rows go to the walker.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..interp.controls import _range, python_pattern
from ..interp.walk import EPSILON, Abort, Index, Options, Walker, bounds
from ..operators.validate import CDDL
from ..syntax import ast
from .compile import NotCompilable, _portable

#: Paths through the alternatives of a map's groups that are spelled out.
_MOST_PATHS = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""

    def once(x: Column) -> Column:
        return body(x)

    return F.get(F.transform(F.array(value), once), F.lit(0))


class _Value:
    """A variant and what tests need of it.  ``held`` is a struct of the variant and its kind."""

    def __init__(self, held: Column):
        self.variant, self.kind = held["variant"], held["kind"]
        self.text, self.whole, self.real = (F.try_variant_get(self.variant, "$", t) for t in ("string", "bigint", "double"))
        wide = self.kind.rlike(r"^DECIMAL\((?:19|[23][0-9]),0\)$")  # an integer of over 18 digits, or a float without a fraction
        unsure = F.lit(None).cast("boolean")
        self.is_int = F.when(self.kind == "BIGINT", True).when(wide, unsure).otherwise(False)
        finite = F.when(F.abs(self.real) < math.inf, True).otherwise(unsure)
        self.is_float = F.when(self.kind == "DOUBLE", finite).when(wide, unsure).otherwise(self.kind.startswith("DECIMAL"))

    @staticmethod
    def bound(variant: Column, body: Callable[[_Value], Column]) -> Column:
        return _let(variant, lambda x: _let(F.struct(x.alias("variant"), F.schema_of_variant(x).alias("kind")), lambda held: body(_Value(held))))

    def is_kind(self, name: str) -> Column:
        return self.kind == name


class _JsonCompiler:
    def __init__(self, index: Index):
        self.walker = Walker(index, "json", Options(), False)  # resolves literals, names and groups
        self.index = index
        self.depth = self.nodes = 0

    # -- types

    def type(self, node: ast.Type, v: _Value, scope) -> Column:
        return reduce(or_, [self.type1(x, v, scope) for x in node.choices])

    def type1(self, node: ast.Type1, v: _Value, scope) -> Column:
        self.nodes += 1
        if node.op is None:
            return self.type2(node.base, v, scope)
        if isinstance(node.op, ast.Range):
            low, high, inclusive = self.walker.limits(node, scope)
            value, kind = (v.whole, v.is_int) if low.kind == "int" else (v.real, v.is_float)
            return kind & (value >= self.number(low)) & (value <= self.number(high) if inclusive else value < self.number(high))
        return self.control(node, v, scope)

    def number(self, value: ast.Value) -> Column:
        if value.kind == "int" and not -(1 << 63) <= value.value < 1 << 63:
            raise NotCompilable("an integer beyond 64 bits")
        return F.lit(value.value)

    def control(self, node: ast.Type1, v: _Value, scope) -> Column:
        name, operand = node.op.name, node.op.operand
        if name in ("cat", "det", "plus"):
            return reduce(or_, [self.literal(x, v) for x in self.walker.literals(node, scope)])
        target = self.type2(node.base, v, scope)
        if name == "default":
            return target
        if name in ("and", "within", "eq"):
            return target & self.type2(operand, v, scope)
        if name == "ne":
            return target & ~self.type2(operand, v, scope)
        literals = self.walker.literals(operand, scope)
        if name in ("lt", "le", "gt", "ge") and literals and literals[0].kind in ("int", "float"):
            limit = self.number(literals[0])

            def compared(x: Column) -> Column:
                return {"lt": x < limit, "le": x <= limit, "gt": x > limit, "ge": x >= limit}[name]

            return target & ((v.is_int & compared(v.whole)) | (v.is_float & compared(v.real)))
        if name == "size":
            return target & self.size(operand, literals, v, scope)
        if name in ("regexp", "pcre", "iregexp") and literals and len(literals) == 1 and literals[0].kind == "text" and _portable(literals[0].value):
            own = python_pattern(literals[0].value, name).replace(r"\Z", r"\z")
            return target & v.is_kind("STRING") & v.text.rlike(f"(?d){own}" if name == "regexp" else rf"(?d)\A(?:{own})\z")
        raise NotCompilable(f".{name}")

    def size(self, operand: ast.Node, literals, v: _Value, scope) -> Column:
        span = _range(self.walker, operand, scope)
        if span is not None:
            low, high, inclusive = self.walker.limits(span, scope)
            first, last = low.value, high.value if inclusive else high.value - 1
        elif literals and len(literals) == 1 and literals[0].kind == "int":
            first = last = literals[0].value
        else:
            raise NotCompilable(".size of this")
        fits = F.lit(True) if last >= 8 else v.whole < 256 ** max(last, 0)
        return (v.is_kind("STRING") & F.octet_length(v.text).between(first, last)) | (v.is_int & (v.whole >= 0) & (fits if last > 0 else F.lit(False)))

    def type2(self, node: ast.Node, v: _Value, scope) -> Column:
        match node:
            case ast.Value():
                return self.literal(node, v)
            case ast.Paren(inner):
                return self.type(inner, v, scope)
            case ast.AnyItem():
                return F.lit(True)
            case ast.Name():
                return self.name(node, v, scope)
            case ast.EnumGroup() | ast.EnumName():
                found = self.walker.literals(node, scope)
                if not found:
                    raise NotCompilable("an enumeration of types")
                return reduce(or_, [self.literal(x, v) for x in found])
            case ast.Array(group):
                return self.array(group, v, scope)
            case ast.Map(group):
                return self.map(group, v, scope)
        raise NotCompilable(type(node).__name__)

    def literal(self, node: ast.Value, v: _Value) -> Column:
        if node.kind == "int":
            return v.is_int & (v.whole == self.number(node))
        if node.kind == "float":
            return v.is_float & ((v.real == node.value) | (F.abs(v.real - node.value) < EPSILON))
        return v.is_kind("STRING") & (v.text == F.lit(node.value)) if node.kind == "text" else F.lit(False)

    def name(self, node: ast.Name, v: _Value, scope) -> Column:
        if (found := self.walker.bound(node, scope)) is not None:
            return self.type1(found[0], v, found[1])
        if rules := self.index.types.get(node.key):
            self.depth += 1
            if self.depth > 32:
                raise NotCompilable(f"{node.key} refers to itself")
            try:
                return reduce(or_, [self.type(r.type, v, self.walker.scope_of(r, node, scope)) for r in rules])
            finally:
                self.depth -= 1
        if node.key in self.index.groups or node.ident not in ast.PRELUDE or node.socket:
            raise NotCompilable(node.key)
        match node.ident:
            case "any":
                return F.lit(True)
            case "uint":
                return v.is_int & (v.whole >= 0)
            case "nint":
                return v.is_int & (v.whole < 0)
            case "int":
                return v.is_int
            case "number":
                return v.is_int | v.is_float
            case "float" | "float16" | "float32" | "float64" | "float16-32" | "float32-64":
                return v.is_float
            case "tstr" | "text":
                return v.is_kind("STRING")
            case "bool":
                return v.is_kind("BOOLEAN")
            case "true" | "false":
                return v.is_kind("BOOLEAN") & (F.try_variant_get(v.variant, "$", "boolean") == F.lit(node.ident == "true"))
            case "null" | "nil":
                return v.is_kind("VOID")
        raise NotCompilable(node.ident)

    # -- containers

    def array(self, group: ast.Group, v: _Value, scope) -> Column:
        for e in (e for choice in group.choices for e in choice):
            only = e.type.choices[0] if e.type and len(e.type.choices) == 1 else None
            if e.group is not None or e.key is not None or only is not None and only.op is None and (isinstance(only.base, ast.Unwrap) or isinstance(only.base, ast.Name) and self.walker.group_of(only.base, scope) is not None):
                raise NotCompilable("a group inside an array")
        choices = group.choices or [[]]
        test = _let(F.try_variant_get(v.variant, "$", "array<variant>"), lambda items: F.when(items.isNotNull(), reduce(or_, [self.items(c, items, scope) for c in choices])).otherwise(False))
        return F.when(v.is_kind("VOID"), False).otherwise(test)

    def items(self, choice: list[ast.Entry], items: Column, scope) -> Column:
        *head, last = choice or [None]
        if any(e.occur is not None for e in head):
            raise NotCompilable("a repetition before the end of an array")
        if last is not None and last.occur is None:
            head, last = choice, None
        tests = [self.at(items, k, e.type, scope) for k, e in enumerate(head)]
        if last is None:
            sized = F.size(items) == len(head)
        else:
            low, high = bounds(last.occur)
            sized = F.size(items) >= len(head) + low
            if high != math.inf:
                sized = sized & (F.size(items) <= len(head) + int(high))
            rest = F.slice(items, len(head) + 1, F.greatest(F.size(items) - len(head), F.lit(0))) if head else items
            tests.append(self.every(rest, last.type, scope))
        return F.when(sized, reduce(and_, tests, F.lit(True))).otherwise(False)

    def at(self, items: Column, k: int, node: ast.Type, scope) -> Column:
        return _Value.bound(F.get(items, F.lit(k)), lambda v: self.type(node, v, scope))

    def every(self, items: Column, node: ast.Type, scope) -> Column:
        return F.forall(items, lambda x: _Value.bound(x, lambda v: self.type(node, v, scope)))

    def map(self, group: ast.Group, v: _Value, scope) -> Column:
        choices = group.choices or [[]]
        return _let(F.try_variant_get(v.variant, "$", "map<string,variant>"), lambda held: F.when(held.isNotNull(), reduce(or_, [self.members(c, held, scope) for c in choices])).otherwise(False))

    def members(self, entries: list[ast.Entry], held: Column, scope) -> Column:
        """Whether one choice of a map matches and leaves no member over."""
        return reduce(or_, [succeeds & complete & (F.size(held) == sum((F.map_contains_key(held, F.lit(k)).cast("int") for k in sorted(keys)), F.lit(0))) for succeeds, complete, keys in self.paths(entries, held, scope)])

    def paths(self, entries: list[ast.Entry], held: Column, scope) -> list[tuple[Column, Column, frozenset[str]]]:
        """Ways through the alternatives of spliced groups: when the matcher takes one, whether all present
        members fit then, and the names that it asks for.  The first alternative that succeeds is taken."""
        parts = [self.entry(e, held, scope) for e in entries]
        if math.prod(map(len, parts)) > _MOST_PATHS:
            raise NotCompilable("too many alternatives")
        out = []
        for path in product(*parts):
            keys = [k for p in path for k in p[2]]
            if len(keys) != len(set(keys)):
                raise NotCompilable("two members of one name")
            out.append((reduce(and_, [p[0] for p in path], F.lit(True)), reduce(and_, [p[1] for p in path], F.lit(True)), frozenset(keys)))
        return out

    def entry(self, e: ast.Entry, held: Column, scope) -> list[tuple[Column, Column, frozenset[str]]]:
        self.nodes += 1
        low, high = bounds(e.occur)
        if e.group is not None:
            alternatives = [self.paths(c, held, scope) for c in e.group.choices]
        elif e.key is None:
            only = e.type.choices[0] if len(e.type.choices) == 1 else None
            if only is None or only.op is not None:
                raise NotCompilable("a member without a name")
            if isinstance(only.base, ast.Unwrap):
                target, inner = self.walker.unwrapped(only.base.name, scope)
                if not isinstance(target, ast.Map):
                    raise NotCompilable("unwrapping of what is no map")
                alternatives = [self.paths(c, held, inner) for c in target.group.choices]
            elif isinstance(only.base, ast.Name) and (found := self.walker.group_of(only.base, scope)) is not None:
                self.depth += 1
                if self.depth > 32:
                    raise NotCompilable("a group in terms of itself")
                alternatives = [self.entry(x, held, s) for x, s in found]
                self.depth -= 1
            else:
                raise NotCompilable("a member without a name")
        else:
            return [self.member(e, low, high, held, scope)]
        if (low, high) != (1, 1):
            raise NotCompilable("a repeated group")
        if not alternatives:  # a socket without plugs
            return [(F.lit(True), F.lit(True), frozenset())]
        out, before = [], F.lit(True)
        for paths in alternatives:
            out += [(before & succeeds, complete, keys) for succeeds, complete, keys in paths]
            before = before & ~reduce(or_, [succeeds for succeeds, _, _ in paths])
        return out

    def member(self, e: ast.Entry, low: int, high: float, held: Column, scope) -> tuple[Column, Column, frozenset[str]]:
        key = e.key.word if e.key.word is not None else e.key.value.value if e.key.value else None
        if key is None and e.key.type and e.key.type.op is None and isinstance(e.key.type.base, ast.Value):
            key = e.key.type.base.value
        if not isinstance(key, str) or high != 1:
            raise NotCompilable("a member without a literal name of its own")
        there = F.map_contains_key(held, F.lit(key))
        fits = _Value.bound(held[key], lambda v: self.type(e.type, v, scope))
        if low:
            ok = F.when(there, fits).otherwise(F.lit(False))
            return ok, F.lit(True), frozenset([key])
        ok = F.when(there, fits).otherwise(F.lit(True))
        # without a cut, a member that doesn't fit is passed over, and left over in the end
        return (ok, F.lit(True), frozenset([key])) if e.key.cut else (F.lit(True), ok, frozenset([key]))


def compile_json(schema: CDDL | str, document: str | Column, *, rule: str | None = None, options: Options = Options()) -> Column:
    """A boolean Column over JSON text: whether it matches a rule, NULL where that takes the walker.

    Raises NotCompilable for rules, and for options that change results.
    """
    if options != Options():
        raise NotCompilable("options")
    own = schema if isinstance(schema, CDDL) else CDDL(schema)
    root, text = own.root(rule), F.col(document) if isinstance(document, str) else document
    compiler = _JsonCompiler(Index(own.tree))
    start = ast.Name(root.lstrip("$"), root[: len(root) - len(root.lstrip("$"))])
    parsed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    try:
        test = _let(parsed, lambda items: F.when(F.size(items) == 1, _Value.bound(F.get(items, F.lit(0)), lambda v: compiler.name(start, v, {}))))
    except (Abort, RecursionError) as e:
        raise NotCompilable(str(e)) from None
    # a text with a closing bracket might end the one put around it: it must also be a value inside a map
    closed = ~text.contains("]") | F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}"))).isNotNull()
    zero = text.contains("-0") & text.rlike(r"(?:^|[\[,:\s])-0(?:$|[\],}\s])")
    sure = (F.length(text) <= options.max_work // (8 * max(1, compiler.nodes))) & ~text.contains("\\u") & ~zero & closed
    return F.when(sure, test)
