"""Ledger documents: schemas by era, and issues that only come from chunked byte strings.

A ledger accepts a byte string of over 64 bytes if it comes in chunks of at most 64.  Such strings
break a schema's size limits.  So a document is validated twice: as it is, and with these strings cut
to 64 bytes; issues that vanish are the ledger's own way of writing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..interp.walk import Index, Options
from ..model import cbor
from ..model.nodes import Item
from .repeats import different, memory, recalled
from .validate import _FEW, CDDL, _index, _prepared, check

CHUNK, MAX_EMBEDDED = 64, 16


def era_schema(spark: SparkSession, folder: str, era: str) -> CDDL:
    """The schema ``<era>.cddl`` of a folder that Spark can read, as it is now."""
    return CDDL(spark.read.text(f"{folder}/{era}.cddl", wholetext=True).first()["value"])


def ledger_view(item: Item, depth: int = 0) -> Item:
    """``item`` with chunked byte strings that the ledger accepts cut to ``CHUNK`` bytes, also inside
    embedded documents (tag 24)."""
    if item.kind == "bytes":
        if item.indefinite and len(item.value) > CHUNK and all(len(c) <= CHUNK for c in item.chunks or []):
            return Item("bytes", item.value[:CHUNK])
        return item
    if item.kind == "tag":
        if item.extra == 24 and item.value.kind == "bytes" and depth < MAX_EMBEDDED:
            try:
                inner = cbor.decode(item.value.value)
            except cbor.CBORError:
                return item
            view = cbor.encode(ledger_view(inner, depth + 1))
            return item if view == item.value.value else Item("tag", Item("bytes", view), 24)
        return Item("tag", ledger_view(item.value, depth), item.extra)
    if item.kind == "array":
        return Item("array", [ledger_view(x, depth) for x in item.value], None, item.indefinite)
    if item.kind == "map":
        return Item("map", [(ledger_view(k, depth), ledger_view(v, depth)) for k, v in item.value], None, item.indefinite)
    return item


def classified(index: Index, rule: str, raw: bytes, options: Options) -> tuple[str, list[tuple[str, str, str]]]:
    """Status, and issues as (path, reason, class): schema, malformedDocument or ledgerChunkedBytes."""
    status, issues = check(index, rule, raw, "cbor", options)
    if status != "mismatch":
        return status, [(i.path, i.reason, i.kind) for i in issues]
    view = cbor.encode(ledger_view(cbor.decode(raw)))
    left = {(i.path, i.reason) for i in check(index, rule, view, "cbor", options)[1]} if view != raw else None
    return status, [(i.path, i.reason, "schema" if left is None or (i.path, i.reason) in left else "ledgerChunkedBytes") for i in issues]


_KIND = pa.struct([("status", pa.string()), ("matches_schema", pa.bool_()), ("is_ledger_valid", pa.bool_()), ("issues", pa.list_(pa.struct([(n, pa.string()) for n in ("path", "reason", "class")])))])


def classify_ledger(df: DataFrame, schema: CDDL | str, column: str, *, rule: str = "transaction", options: Options = Options(), output: str = "ledger") -> DataFrame:
    """``df`` with status, matches_schema (no issue at all), is_ledger_valid (none of class schema or
    malformedDocument) and the classified issues.  A null document has a null result."""
    text, root = _prepared(schema, rule, "cbor")

    @F.arrow_udf("struct<status:string,matches_schema:boolean,is_ledger_valid:boolean,issues:array<struct<path:string,reason:string,class:string>>>")
    def verdict(documents: pa.Array) -> pa.Array:
        values, _, place = different(documents)
        index, known = _index(text), memory("ledger", text, root, options)

        def one(raw: bytes) -> dict:
            status, issues = classified(index, root, raw, options)
            good = status in ("valid", "mismatch") and all(c == "ledgerChunkedBytes" for _, _, c in issues)
            return {"status": status, "matches_schema": status == "valid", "is_ledger_valid": good, "issues": [dict(zip(("path", "reason", "class"), i)) for i in issues]}

        own = [recalled(known, d, lambda: one(d), lambda out: len(out["issues"]) <= _FEW) for d in values.to_pylist()]  # noqa: B023
        return pa.array(own, _KIND).take(place)

    return df.withColumn(output, verdict(F.col(column)))
