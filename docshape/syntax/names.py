"""Checks of the names in a schema."""

from __future__ import annotations

from collections.abc import Iterator

from . import ast


class SchemaError(ValueError):
    """A schema that parses but can't be used; ``line`` counts from 1."""

    def __init__(self, message: str, line: int):
        super().__init__(f"line {line}: {message}")
        self.line = line


def duplicate_definitions(schema: ast.Schema) -> list[ast.Rule]:
    """Rules that define a name anew with ``=`` after any definition of it."""
    seen: set[str] = set()
    out = []
    for rule in schema.rules:
        if rule.op == "=" and rule.name.key in seen:
            out.append(rule)
        seen.add(rule.name.key)
    return out


def references(schema: ast.Schema) -> Iterator[tuple[ast.Rule, ast.Name]]:
    """All names that rules refer to, in order."""
    for rule in schema.rules:
        for node in (rule.type or rule.entry).walk():
            if isinstance(node, ast.Name):
                yield rule, node


def undefined_references(schema: ast.Schema) -> list[tuple[ast.Rule, ast.Name]]:
    """References that no rule, parameter, prelude name or socket explains."""
    known = {r.name.key for r in schema.rules} | set(ast.PRELUDE)
    return [(rule, name) for rule, name in references(schema) if not name.socket and name.ident not in known and name.ident not in rule.params]


def checked(schema: ast.Schema) -> ast.Schema:
    """``schema`` itself; raises SchemaError for its first duplicate or undefined name."""
    for rule in duplicate_definitions(schema):
        raise SchemaError(f"{rule.name.key} is defined already", rule.line)
    for rule, name in undefined_references(schema):
        line = schema.source.count("\n", 0, name.pos) + 1 if schema.source else rule.line
        raise SchemaError(f"{name.key} is not defined", line)
    return schema
