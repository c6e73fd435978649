"""Schema-driven analytics over semi-structured documents on PySpark.

A schema in CDDL (RFC 8610 with its later control operators) is parsed on the driver and applied to
whole columns of JSON text, CBOR bytes or typed structs.
"""
