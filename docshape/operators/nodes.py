"""Documents as node tables: one row per item, for joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import cbor, jsontext
from ..model.nodes import Item, path_key

_FIELDS = [
    ("node_id", "int", pa.int32()), ("parent_id", "int", pa.int32()), ("role", "string", pa.string()), ("pos", "int", pa.int32()), ("depth", "int", pa.int32()),
    ("path", "string", pa.string()), ("kind", "string", pa.string()), ("int_val", "decimal(20,0)", pa.decimal128(20, 0)), ("float_val", "double", pa.float64()),
    ("float_width", "int", pa.int32()), ("text_val", "string", pa.string()), ("bytes_val", "binary", pa.binary()), ("bool_val", "boolean", pa.bool_()),
    ("tag", "decimal(20,0)", pa.decimal128(20, 0)), ("n_children", "int", pa.int32()), ("indefinite", "boolean", pa.bool_()), ("start", "int", pa.int32()),
    ("header_end", "int", pa.int32()), ("end", "int", pa.int32()), ("flags", "int", pa.int32()), ("complete", "boolean", pa.bool_()), ("encoded", "binary", pa.binary()),
]
_BATCH = 20_000


def _row(node: int, parent: int | None, role: str, pos: int, depth: int, path: str, item: Item | None, n: int, span: cbor.Span | None, raw: bytes | None) -> tuple:
    kind = item.kind if item else "missing"
    value = item.value if item else None
    return (
        node, parent, role, pos, depth, path, kind,
        Decimal(value) if kind == "int" else None, value if kind == "float" else None, item.extra if kind == "float" else None, value if kind == "text" else None,
        value if kind == "bytes" else None, value if kind == "bool" else None, Decimal(item.extra) if kind == "tag" else None, n, bool(item and item.indefinite),
        *((span.start, span.header_end, span.end, span.flags, span.complete) if span else (None, None, None, None, True)),
        raw[span.start : span.end] if span and role == "key" else None,
    )


def _cbor_rows(raw: bytes) -> Iterator[tuple]:
    root, _ = cbor.decode_annotated(raw)
    stack = [(root, None, "root", 0, 0, "")] if root else []
    node = 0
    while stack:
        span, parent, role, pos, depth, path = stack.pop()
        yield _row(node, parent, role, pos, depth, path, span.item, len(span.children), span, raw)
        below = []
        kind = span.item.kind if span.item else ""
        for k, child in enumerate(span.children):
            if kind == "map":
                name = span.children[k - k % 2]
                step = path_key(name.item, "cbor") if name.item else "?"
                below.append((child, node, "value" if k % 2 else "key", k // 2, depth + 1, f"{path}/{step}"))
            elif kind == "array":
                below.append((child, node, "item", k, depth + 1, f"{path}/{k}"))
            else:
                below.append((child, node, "tag" if kind == "tag" else "chunk", k, depth + 1, path))
        stack.extend(reversed(below))
        node += 1


def _json_rows(text: str) -> Iterator[tuple]:
    try:
        root = jsontext.parse(text)
    except jsontext.JSONError:
        return
    stack = [(root, None, "root", 0, 0, "")]
    node = 0
    while stack:
        item, parent, role, pos, depth, path = stack.pop()
        parts = item.value if item.kind in ("array", "map") else []
        yield _row(node, parent, role, pos, depth, path, item, len(parts) * (2 if item.kind == "map" else 1), None, None)
        below = []
        for k, part in enumerate(parts):
            if item.kind == "map":
                below += [(part[0], node, "key", k, depth + 1, f"{path}/{part[0].value}"), (part[1], node, "value", k, depth + 1, f"{path}/{part[0].value}")]
            else:
                below.append((part, node, "item", k, depth + 1, f"{path}/{k}"))
        stack.extend(reversed(below))
        node += 1


def decode_nodes(df: DataFrame, key: str, column: str, model: str = "cbor") -> DataFrame:
    """``(key, node_id, parent_id, role, pos, depth, path, kind, values, spans, flags)``, in pre-order.

    CBOR is decoded as far as it goes: a cut-off document has incomplete nodes.  JSON nodes have no
    spans or flags; a text that isn't JSON has no nodes.  Null documents have none.
    """
    kind = df.schema[key].dataType
    rows_of = _cbor_rows if model == "cbor" else _json_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(n for n, _, _ in _FIELDS)]
        for batch in batches:
            own, documents = batch.column(0), batch.column(1)
            rows, index = [], []

            def flush() -> pa.RecordBatch:
                columns = list(zip(*rows))
                out = [own.take(pa.array(index, pa.int64())), *(pa.array(list(c), t) for c, (_, _, t) in zip(columns, _FIELDS))]
                rows.clear()
                index.clear()
                return pa.RecordBatch.from_arrays(out, names)

            for k, document in enumerate(documents):
                if document.is_valid:
                    for row in rows_of(document.as_py()):
                        rows.append(row)
                        index.append(k)
                        if len(rows) >= _BATCH:
                            yield flush()
            if rows:
                yield flush()

    schema = f"`{key}` {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t, _ in _FIELDS)
    return df.select(key, column).mapInArrow(run, schema)


def flags_by_window(nodes: DataFrame, key: str) -> DataFrame:
    """For each map: whether its keys are unsorted or repeated, from the keys' encoded bytes."""
    keys = nodes.where("role = 'key'").select(key, "parent_id", "pos", F.hex("encoded").alias("k"))
    order = Window.partitionBy(key, "parent_id").orderBy("pos")
    ranked = keys.withColumn("unsorted", F.coalesce(F.lag("k").over(order) > F.col("k"), F.lit(False)))
    return ranked.groupBy(key, F.col("parent_id").alias("node_id")).agg(F.max("unsorted").alias("unsorted"), (F.count("k") > F.countDistinct("k")).alias("duplicates"))


def items_at(nodes: DataFrame, offsets: DataFrame, key: str, offset: str = "offset") -> DataFrame:
    """The innermost item at each byte offset: ``(key, offset, path, kind, node_id)``.

    An equi-join by document and a range test inside it; null where no item holds the byte.  Both joins sort:
    Spark takes node tables for as small as the files that they were made from, and would broadcast them.
    """
    spans = nodes.where("start is not null").select(key, "node_id", "path", "kind", "depth", "start", "end")
    hit = offsets.select(key, offset).distinct().join(spans.hint("merge"), key, "left").where(F.col("start").isNull() | ((F.col("start") <= F.col(offset)) & (F.col(offset) < F.col("end"))))
    best = hit.groupBy(key, offset).agg(F.max_by(F.struct("path", "kind", "node_id"), F.struct("depth", "node_id")).alias("at"))
    return offsets.join(best.hint("merge"), [key, offset], "left").select(key, offset, "at.path", "at.kind", "at.node_id")


def items_of_issues(nodes: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Each issue with the span of the item that its path names (tags share their content's path).

    The join sorts, as that of ``items_at``.
    """
    seats = nodes.where("role <> 'key' and role <> 'chunk'").groupBy(key, "path").agg(F.min_by(F.struct("node_id", "start", "end"), "depth").alias("at"))
    return issues.join(seats.hint("merge"), [key, "path"], "left").select(issues["*"], "at.node_id", "at.start", "at.end")


def cbor_sequence_items(df: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, pos, item)``: the encoded items of CBOR sequences, one row each; none for what is malformed."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, places, items = [], [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    found, at = [], 0
                    while raw is not None and at < len(raw):
                        _, end = cbor.decode_prefix(raw, at)
                        found.append(raw[at:end])
                        at = end
                except cbor.CBORError:
                    continue
                index += [k] * len(found)
                places += range(len(found))
                items += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(places, pa.int32()), pa.array(items, pa.binary())], [key, "pos", "item"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind.simpleString()}, pos int, item binary")


