"""The syntax tree of a schema: plain dataclasses, picklable, compared by content."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields


class Node:
    """Any part of the tree."""

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in the order of the text; without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(list(node.children())))


def _nodes(value) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, (list, tuple)):
        for one in value:
            yield from _nodes(one)


@dataclass(eq=True)
class Name(Node):
    """A reference: ``ident``, ``$ident`` or ``$$ident``, perhaps with generic arguments."""

    ident: str
    socket: str = ""
    args: list[Type1] = field(default_factory=list)
    pos: int = field(default=0, compare=False)

    @property
    def key(self) -> str:
        return self.socket + self.ident


@dataclass(eq=True)
class Value(Node):
    """A literal; ``kind`` is int, float, text or bytes; ``text`` is how it was written."""

    kind: str
    value: int | float | str | bytes
    text: str = field(default="", compare=False)


@dataclass(eq=True)
class Paren(Node):
    type: Type


@dataclass(eq=True)
class Map(Node):
    group: Group


@dataclass(eq=True)
class Array(Node):
    group: Group


@dataclass(eq=True)
class Unwrap(Node):
    name: Name


@dataclass(eq=True)
class EnumGroup(Node):
    group: Group


@dataclass(eq=True)
class EnumName(Node):
    name: Name


@dataclass(eq=True)
class Tagged(Node):
    """``#6.n(t)``; ``tag`` is a number, the text of a tag type, or None for any tag."""

    tag: int | str | None
    type: Type
    bare: bool = False  # written #(t)


@dataclass(eq=True)
class Major(Node):
    """``#n`` and ``#n.c``."""

    major: int
    constraint: int | str | None = None


@dataclass(eq=True)
class AnyItem(Node):
    """``#``."""


@dataclass(eq=True)
class Range(Node):
    inclusive: bool
    bound: Node


@dataclass(eq=True)
class Control(Node):
    name: str
    operand: Node


@dataclass(eq=True)
class Type1(Node):
    base: Node
    op: Range | Control | None = None


@dataclass(eq=True)
class Type(Node):
    choices: list[Type1]


@dataclass(eq=True)
class Occur(Node):
    """From ``low`` to ``high`` times; no ``high`` is no bound.  ``text`` is as written."""

    low: int
    high: int | None
    text: str = field(default="", compare=False)


@dataclass(eq=True)
class Key(Node):
    """A member key: a type (with ``=>``), a bareword or a literal (with ``:``)."""

    type: Type1 | None = None
    word: str | None = None
    value: Value | None = None
    cut: bool = False


@dataclass(eq=True)
class Entry(Node):
    """One entry of a group: a type with or without a key, or an inline group."""

    occur: Occur | None = None
    key: Key | None = None
    type: Type | None = None
    group: Group | None = None
    pos: int = field(default=0, compare=False)


@dataclass(eq=True)
class Group(Node):
    choices: list[list[Entry]]


@dataclass(eq=True)
class Rule(Node):
    """``name<params> = type`` or a group rule; ``op`` is =, /= or //=."""

    name: Name
    params: list[str]
    op: str
    type: Type | None = None
    entry: Entry | None = None
    pos: int = field(default=0, compare=False)
    end: int = field(default=0, compare=False)
    line: int = field(default=0, compare=False)

    @property
    def is_type(self) -> bool:
        return self.type is not None


@dataclass(eq=True)
class Comment(Node):
    pos: int
    text: str


@dataclass(eq=True)
class Schema(Node):
    rules: list[Rule]
    comments: list[Comment] = field(default_factory=list, compare=False)
    source: str = field(default="", compare=False)

    def root(self, name: str | None = None) -> str:
        """The rule to validate against: the named one, or the first type rule without parameters."""
        for rule in self.rules:
            if rule.name.key == name if name else rule.is_type and not rule.params and rule.op == "=":
                return rule.name.key
        raise KeyError(name or "no type rule")


#: Control operators.
CONTROLS = (
    "size bits regexp pcre iregexp cbor cborseq within and lt le gt ge eq ne default bitfield cat det plus "
    "abnf abnfb feature b64u b64c b64u-sloppy b64c-sloppy hex hexlc hexuc b32 h32 b45 base10 printf json join"
).split()

#: Names that every schema knows, with the tag and inner type of those that are tagged.
PRELUDE = (
    "any uint nint int bstr bytes tstr text tdate time number biguint bignint bigint integer unsigned decfrac bigfloat "
    "eb64url eb64legacy eb16 encoded-cbor uri b64url b64legacy regexp mime-message cbor-any float16 float32 float64 "
    "float16-32 float32-64 float false true bool nil null undefined"
).split()
TAGS = {
    "tdate": (0, "tstr"), "time": (1, "number"), "biguint": (2, "bstr"), "bignint": (3, "bstr"), "eb64url": (21, "any"), "eb64legacy": (22, "any"),
    "eb16": (23, "any"), "encoded-cbor": (24, "bstr"), "uri": (32, "tstr"), "b64url": (33, "tstr"), "b64legacy": (34, "tstr"), "regexp": (35, "tstr"),
    "mime-message": (36, "tstr"), "cbor-any": (55799, "any"),
}
