"""Codecs as Arrow UDFs over whole batches."""

from __future__ import annotations

import base64

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..interp.controls import decoded
from ..model import cbor, jsontext
from ..model.nodes import Item


def _encoded(values: pa.Array) -> pa.Array:
    """Each value as CBOR.  A struct is joined from its fields; of whole numbers and texts each different one is encoded once."""
    kind, null = values.type, pa.scalar(b"\xf6", pa.binary())
    if pa.types.is_struct(kind) and 0 < kind.num_fields and len({f.name for f in kind}) == kind.num_fields:
        parts = [pa.scalar(cbor.head(5, kind.num_fields), pa.binary())]
        for field, own in zip(kind, values.flatten()):
            parts += [pa.scalar(cbor.encode(Item("text", field.name)), pa.binary()), _encoded(own)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary()))
        return pc.if_else(values.is_valid(), joined, null) if values.null_count else joined
    if pa.types.is_integer(kind) or pa.types.is_string(kind):
        coded = values.dictionary_encode()
        each = pa.array([cbor.encode(Item("int" if pa.types.is_integer(kind) else "text", v)) for v in coded.dictionary.to_pylist()], pa.binary())
        return pc.fill_null(each.take(coded.indices), null)
    return pa.array([cbor.encode(cbor.item_of(v)) for v in values.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def cbor_encode(values: pa.Array) -> pa.Array:
    """A struct, array, string, binary, number or boolean as CBOR; struct fields become text keys in
    order, and null fields CBOR null.  Encoding is the shortest."""
    return _encoded(values)


@F.arrow_udf(T.BinaryType())
def cbor_encode_present(values: pa.Array) -> pa.Array:
    """As ``cbor_encode``, but a null struct field is an absent member."""

    def present(v):
        if isinstance(v, dict):
            return {k: present(x) for k, x in v.items() if x is not None}
        return [present(x) for x in v] if isinstance(v, list) else v

    return pa.array([cbor.encode(cbor.item_of(present(v))) for v in values.to_pylist()], pa.binary())


def _plain(item: Item):
    match item.kind:
        case "map":
            return Item("map", [(k if k.kind == "text" else Item("text", jsontext.dump(_plain(k))), _plain(v)) for k, v in item.value])
        case "array":
            return Item("array", [_plain(x) for x in item.value])
        case "tag":
            return Item("int", item.bignum) if item.bignum is not None else _plain(item.value)
        case "bytes":
            return Item("text", base64.urlsafe_b64encode(item.value).decode().rstrip("="))
        case "float":
            return item if item.value - item.value == 0 else Item("null")
        case "undefined" | "simple":
            return Item("null")
    return item


@F.arrow_udf(T.StringType())
def cbor_decode_json(documents: pa.Array) -> pa.Array:
    """CBOR as JSON text by RFC 8949's advice: bytes in base64url, tags dropped; null if malformed."""

    def one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else jsontext.dump(_plain(cbor.decode(raw)))
        except cbor.CBORError:
            return None

    return pa.array([one(d) for d in documents.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def json_compact(documents: pa.Array) -> pa.Array:
    """JSON without blanks, repeated names resolved, numbers as written; null if malformed."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else jsontext.dump(jsontext.parse(text))
        except jsontext.JSONError:
            return None

    return pa.array([one(d) for d in documents.to_pylist()], pa.string())


def text_decode(column: str | Column, codec: str) -> Column:
    """The bytes of text in b64u, b64c (and -sloppy), hex, hexlc, hexuc, b32, h32 or b45; null if it is none."""

    @F.arrow_udf(T.BinaryType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else decoded(codec, t) for t in texts.to_pylist()], pa.binary())

    return run(F.col(column) if isinstance(column, str) else column)
