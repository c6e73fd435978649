"""Column functions: codecs between values, JSON text and CBOR bytes."""

from .codecs import cbor_decode_json, cbor_encode, json_compact, text_decode

__all__ = ["cbor_decode_json", "cbor_encode", "json_compact", "text_decode"]
