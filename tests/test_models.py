import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docshape.model import cbor, jsontext, scanners
from docshape.model.nodes import equal, identical

PLAIN = st.recursive(
    st.none() | st.booleans() | st.integers(-(1 << 70), 1 << 70) | st.floats(allow_nan=False) | st.text() | st.binary(),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4),
    max_leaves=20,
)


@settings(max_examples=150, deadline=None)
@given(PLAIN)
def test_cbor_round_trip(value):
    item = cbor.item_of(value)
    raw = cbor.encode(item)
    assert identical(cbor.decode(raw), item)
    root, error = cbor.decode_annotated(raw)
    assert error is None and root.end == len(raw) and root.flags & ~(cbor.UNSORTED | cbor.DUPLICATES) == 0
    for cut in {0, len(raw) // 2, len(raw) - 1}:
        with pytest.raises(cbor.CBORError):
            cbor.decode(raw[:cut])


@pytest.mark.parametrize(
    "raw",
    ["", "18", "1c", "1f", "41", "61ff", "5f6161ff", "5f41", "9f", "ff", "82", "a1", "a101", "bf01ff", "f800", "f81f", "0000", "c1", "df", "9b7fffffffffffffff"],
)
def test_malformed_cbor(raw):
    with pytest.raises(cbor.CBORError):
        cbor.decode(bytes.fromhex(raw))
    cbor.decode_annotated(bytes.fromhex(raw))


def test_cbor_details():
    assert cbor.encode(cbor.decode(bytes.fromhex("5f41014102ff"))).hex() == "5f41014102ff"
    assert [x.value for x in cbor.decode_sequence(bytes.fromhex("0102f5"))] == [1, 2, True]
    assert cbor.decode(b"\x81" * 2000 + b"\x00").kind == "array"
    with pytest.raises(cbor.CBORError):
        cbor.decode(b"\x81" * (cbor.MAX_DEPTH + 1) + b"\x00")
    assert cbor.decode(bytes.fromhex("c249010000000000000000")).bignum == 1 << 64
    assert math.isnan(cbor.decode(bytes.fromhex("f97e00")).value)
    root, _ = cbor.decode_annotated(bytes.fromhex("a3616200616100616100"))
    assert root.flags == cbor.UNSORTED | cbor.DUPLICATES and root.children[4].flags == cbor.DUPLICATE
    assert cbor.decode_annotated(bytes.fromhex("1805"))[0].flags == cbor.OVERLONG
    assert cbor.decode_annotated(bytes.fromhex("fb3ff8000000000000"))[0].flags == cbor.WIDE_FLOAT
    root, error = cbor.decode_annotated(bytes.fromhex("8301"))
    assert error and not root.complete and root.children[0].complete


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", "{,}", '{"a"}', '{"a":}', "01", "1.", "-", "+1", "nul", "tru", '"\n"', '"\\x"', '"\\ud800"', "[1 2]", "1 1", "'a'", "NaN", "{1:2}", '{"a":1,}'])
def test_malformed_json(text):
    with pytest.raises(jsontext.JSONError):
        jsontext.parse(text)


def test_json_details():
    kinds = {t: jsontext.parse(t).kind for t in ("1", "1.0", "1e3", "-0", "18446744073709551615", "18446744073709551616", "-18446744073709551616")}
    assert kinds == {"1": "int", "1.0": "float", "1e3": "float", "-0": "float", "18446744073709551615": "int", "18446744073709551616": "float", "-18446744073709551616": "int"}
    assert jsontext.dump(jsontext.parse(' {"b": 1.0, "a": [ -0, "\\u00e9\\n"], "b": 2}')) == '{"a":[-0,"é\\n"],"b":2}'
    assert jsontext.dump(jsontext.parse('{"b":1,"b":2}', as_written=True)) == '{"b":1,"b":2}'
    assert jsontext.parse("[" * 5000 + "]" * 5000).kind == "array"
    with pytest.raises(jsontext.JSONError) as e:
        jsontext.parse('{\n "a": x}')
    assert (e.value.line, e.value.column) == (2, 7)
    assert not equal(cbor.item_of(math.nan), cbor.item_of(math.nan)) and identical(cbor.item_of(math.nan), cbor.item_of(math.nan))


def test_scanners():
    for good in ("2020-02-29T10:00:60Z", "2021-01-01t00:00:00.5z", "2021-01-01 00:00:00+23:59", "2021-01-01T00:00:00−01:00"):
        assert scanners.is_date(good)
    for bad in ("2021-02-29T00:00:00Z", "2021-01-01T24:00:00Z", "2021-01-01T00:00Z", "2021-01-01T00:00:00", "2021-13-01T00:00:00Z"):
        assert not scanners.is_date(bad)
    for good in ("http://a", "urn:x:y", "http://u@[::1]:80/p?q#f", "mailto:a@b", "file:///x", "a:", "http://[v1.a]/"):
        assert scanners.is_uri(good), good
    for bad in ("", "a", "/x", "http://a b", "http://[::g]/", "http://a:65536/", "http://a/%zz", "1a:b", "http://a#b#c"):
        assert not scanners.is_uri(bad), bad
    assert scanners.decode_base64("QQ==", "b64c", False) == b"A" and scanners.decode_base64("QR==", "b64c", False) is None and scanners.decode_base64("QR==", "b64c", True) == b"A"
    assert scanners.decode_base45("BB8") == b"AB" and scanners.decode_base45("::") is None and scanners.decode_base32("ME", False) == b"a"
