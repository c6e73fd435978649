"""Syntax tree to CDDL text.  What it writes parses to the same tree and is written the same again."""

from __future__ import annotations

import re

from . import ast

_WIDTH = 100


def _escaped(text: str) -> str:
    out = text.replace("\\", "\\\\").replace('"', '\\"')
    for char, plain in (("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = out.replace(char, plain)
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\u{ord(m[0]):04x}", out)


def value_text(value: ast.Value) -> str:
    """A literal; a float keeps its notation, other literals have one form."""
    if value.kind == "text":
        return f'"{_escaped(value.value)}"'
    if value.kind == "bytes":
        return value.text if value.text.startswith(("'", "b64")) and "\n" not in value.text else f"h'{value.value.hex()}'"
    if value.kind == "float":
        return value.text or (repr(value.value) if "." in repr(value.value) or "e" in repr(value.value) else f"{value.value}.0")
    return str(value.value)


def name_text(name: ast.Name) -> str:
    return name.key + (f"<{', '.join(map(type1_text, name.args))}>" if name.args else "")


def type2_text(node: ast.Node) -> str:
    match node:
        case ast.Value():
            return value_text(node)
        case ast.Name():
            return name_text(node)
        case ast.Paren(inner):
            return f"({type_text(inner)})"
        case ast.Map(group):
            return _enclosed("{", group, "}")
        case ast.Array(group):
            return _enclosed("[", group, "]")
        case ast.Unwrap(name):
            return "~" + name_text(name)
        case ast.EnumGroup(group):
            return "&" + _enclosed("(", group, ")")
        case ast.EnumName(name):
            return "&" + name_text(name)
        case ast.Tagged(tag, inner, bare):
            head = "#" if bare else "#6" + ("" if tag is None else f".{tag}" if isinstance(tag, int) else f".<{tag}>")
            return f"{head}({type_text(inner)})"
        case ast.Major(major, constraint):
            return f"#{major}" + ("" if constraint is None else f".{constraint}" if isinstance(constraint, int) else f".<{constraint}>")
        case ast.AnyItem():
            return "#"
    raise TypeError(type(node).__name__)


def type1_text(node: ast.Type1) -> str:
    left = type2_text(node.base)
    match node.op:
        case None:
            return left
        case ast.Range(inclusive, bound):
            dots = ".." if inclusive else "..."
            space = " " if isinstance(node.base, (ast.Name, ast.Unwrap, ast.EnumName)) else ""
            return f"{left}{space}{dots}{space}{type2_text(bound)}"
        case ast.Control(name, operand):
            return f"{left} .{name} {type2_text(operand)}"
    raise TypeError(type(node.op).__name__)


def type_text(node: ast.Type) -> str:
    return " / ".join(map(type1_text, node.choices))


def key_text(key: ast.Key) -> str:
    if key.word is not None:
        return f"{key.word}: "
    if key.value is not None:
        return f"{value_text(key.value)}: "
    return f"{type1_text(key.type)}{' ^' if key.cut else ''} => "


def entry_text(entry: ast.Entry) -> str:
    occur = f"{entry.occur.text} " if entry.occur else ""
    if entry.group is not None:
        return occur + _enclosed("(", entry.group, ")")
    return occur + (key_text(entry.key) if entry.key else "") + type_text(entry.type)


def _enclosed(opening: str, group: ast.Group, closing: str) -> str:
    inner = group_text(group)
    return f"{opening}{inner}{closing}" if len(inner) < 2 or opening != "{" else f"{opening} {inner} {closing}"


def group_text(group: ast.Group) -> str:
    return " // ".join(", ".join(map(entry_text, choice)) for choice in group.choices).strip()


def rule_text(rule: ast.Rule) -> str:
    head = rule.name.key + (f"<{', '.join(rule.params)}>" if rule.params else "") + f" {rule.op} "
    if rule.is_type and len(rule.type.choices) > 2:
        return head + "\n\t/ ".join(map(type1_text, rule.type.choices))
    body = type_text(rule.type) if rule.is_type else entry_text(rule.entry)
    if len(head + body) <= _WIDTH or not rule.is_type:
        return head + body
    only = rule.type.choices[0]
    if len(rule.type.choices) == 1 and only.op is None and isinstance(only.base, (ast.Map, ast.Array)):
        opening, closing = ("{", "}") if isinstance(only.base, ast.Map) else ("[", "]")
        parts = ["".join(f"\t{entry_text(e)},\n" for e in choice) for choice in only.base.group.choices]
        return f"{head}{opening}\n" + "\t//\n".join(parts) + closing
    return head + body


def format_schema(schema: ast.Schema) -> str:
    """The whole schema.  A comment before or inside a rule stands before it, on its own line; a
    comment on a rule's last line stays behind it."""
    left = sorted(schema.comments, key=lambda c: c.pos)
    blocks: list[str] = []

    def line(comment: ast.Comment) -> str:
        return f";{comment.text}".rstrip()

    for rule in schema.rules:
        ahead = []
        while left and left[0].pos < rule.end:
            ahead.append(line(left.pop(0)))
        text = rule_text(rule)
        if left and schema.source and "\n" not in schema.source[rule.end : left[0].pos]:
            text += " " + line(left.pop(0))
        blocks.append("\n".join([*ahead, text]))
    if left:
        blocks.append("\n".join(map(line, left)))
    out = ""
    for k, block in enumerate(blocks):
        lone = "\n" not in block and (k == 0 or "\n" not in blocks[k - 1])
        out += ("" if k == 0 else "\n" if lone else "\n\n") + block
    return out + "\n" if out else ""
