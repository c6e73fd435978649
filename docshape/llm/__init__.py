"""Operators for large-scale training-data preparation.

Each module holds one operator with its own general interface.  The thin
``opN_*`` queries over the driver tables, and their SQL, are in ``queries``.
Nothing outside this subpackage imports it.
"""
