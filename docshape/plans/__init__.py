"""Rules as Catalyst expressions."""

from .compile import NotCompilable, compile_rule, matches

__all__ = ["NotCompilable", "compile_rule", "matches"]
