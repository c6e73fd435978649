"""DataFrame operators: validation, issues, node tables, rule tables, ledger classification."""

from .issues import deepest_issues, explode_issues, issues_by_path
from .ledger import classify_ledger
from .nodes import cbor_sequence_items, decode_nodes, flags_by_window, items_at, items_of_issues
from .rules import duplicate_rules, reference_table, rule_table, undefined_names
from .validate import VERDICT, CDDL, Options, is_valid, validate

__all__ = [
    "CDDL", "VERDICT", "Options", "cbor_sequence_items", "classify_ledger", "decode_nodes", "deepest_issues", "duplicate_rules", "explode_issues", "flags_by_window",
    "is_valid", "issues_by_path", "items_at", "items_of_issues", "reference_table", "rule_table", "undefined_names", "validate",
]
