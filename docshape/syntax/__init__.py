"""CDDL text to syntax tree and back; all of it runs on the driver."""

from .names import SchemaError, duplicate_definitions, undefined_references
from .parse import ParseError, parse
from .text import format_schema

__all__ = ["ParseError", "SchemaError", "duplicate_definitions", "format_schema", "parse", "undefined_references"]
