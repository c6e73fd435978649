import pytest

from docshape.model import cbor
from docshape.operators import CDDL, Options

JSON = [
    # maps: closed, optional, cuts, wildcards, assignment, choices
    ("a = {k: uint}", '{"k":1}', '{"k":-1}', '{}', '{"k":1,"z":2}', "[]"),
    ("a = {k: uint, ? z: tstr}", '{"k":1,"z":"x"}', '{"k":1,"z":2}'),
    ("a = {}", "{}", '{"a":1}'),
    ("a = {? a: uint, * tstr => any}", '{"b":"x"}', '{"a":"x"}'),
    ('a = {? "a" ^ => uint, * tstr => any}', '{"b":"x"}', '{"a":"x"}'),
    ("a = {1*2 tstr => int}", '{"a":1,"b":2}', "{}", '{"a":1,"b":2,"c":3}'),
    ("a = {x: int // y: int}", '{"y":1}', '{"x":1,"y":1}', "{}"),
    ("a = {g, z: int}\ng = (k: int, ? m: int)", '{"k":1,"z":2}', '{"z":2}'),
    ("a = {* g}\ng = (k: int // m: int)", '{"k":1,"m":2}', '{"k":"x"}'),
    ("a = {~b, z: int}\nb = {k: int}", '{"k":1,"z":2}', '{"z":2}'),
    ("a = {* $$x}\n$$x //= (k: int)\n$$x //= (m: tstr)", '{"k":1,"m":"q"}', '{"q":1}'),
    ("a = {int}", "!{}"),
    # arrays
    ("a = [* int]", "[]", '["x"]'),
    ("a = [* b, b]\nb = int", "!", "[1,2]"),
    ("a = [1*2 int, tstr]", '[1,"x"]', '["x"]', "[1,2,3]"),
    ("a = [* (int, tstr)]", '[1,"a",2,"b"]', '[1,"a",2]'),
    ("a = [int // tstr, tstr]", '["a","b"]', '["a"]'),
    ("a = [~b, tstr]\nb = [int, int]", '[1,2,"x"]', '[1,"x"]'),
    ("a = [* ()]", "[]", "[1]"),
    # scalars
    ("a = float", "1.0", "1"), ("a = number", "1", '"1"'), ("a = 1..5", "5", "6", "1.5"), ("a = 1...5", "4", "5"), ("a = 1.0..2.0", "1.5", "1"), ("a = 5..1", "!", "3"),
    ("a = null", "null", "false"), ("a = true", "true", "false"), ("a = bytes", "!", '"x"'), ("a = undefined", "!", "null"), ("a = 1.1", "1.1", "1.2"),
    ("a = time", "1e9", "1e300"), ("a = b64url", '"QUI"', '"QUI="'),
    # names
    ("a = p<int>\np<t> = [t, t]", "[1,2]", '[1,"x"]'), ("a = p<int, q<tstr>>\np<t, u> = [t, u]\nq<t> = {v: t}", '[1,{"v":"x"}]', '[1,{"v":1}]'),
    ("a = 1\na /= 2", "2", "3"), ("a = $s\n$s /= 1", "1", "2"), ("a = $s", "!", "1"), ("a = &(x: 1, y: 2)", "2", "3"), ("a = &g\ng = (1, 2)", "2", "3"), ("a = [a] / int", "[[1]]", '["x"]'), ("a = a", "!", "1"),
    # controls
    ("a = uint .size 1", "255", "256"), ("a = uint .size (0..1)", "255", "256"), ("a = tstr .size 2", '"é"', '"e"'), ("a = tstr .size (1..2)", '"ab"', '""'), ("a = uint .bits &(0, 2)", "5", "2"),
    ('a = tstr .regexp "b"', '"abc"', '"ac"'), ('a = tstr .pcre "b"', '"b"', '"abc"'), ('a = tstr .iregexp "[ab]+"', '"ab"', '"abc"'), ('a = tstr .regexp "b$"', '"ab"', '"b\\n"'),
    ("a = int .lt 5", "4", "5"), ("a = int .le 5", "5", "6"), ("a = int .gt 5", "6", "5"), ("a = int .ge (1..5)", "5", "4"), ("a = int .eq 3", "3", "4"), ("a = int .ne 3", "4", "3"),
    ("a = (int .gt 1) .and (int .lt 5)", "3", "5"), ("a = int .within (1..5)", "3", "6"), ("a = int .default 3", "4", '"x"'), ('a = tstr .feature "x"', '"y"', "1"),
    ('a = "x" .cat "y"', '"xy"', '"x"'), ('a = " x" .det " y"', '"xy"', '" xy"'), ("a = 1 .plus 2", "3", "4"), ("a = 1 .plus 2.9", "3", "4"),
    ("a = tstr .b64u 'hi'", '"aGk"', '"aGk="'), ("a = tstr .b64c 'a'", '"YQ=="', '"YR=="'), ("a = tstr .b64c-sloppy 'a'", '"YR=="', '"YQ"'), ("a = tstr .b64u-sloppy 'a'", '"YR"', '"Y"'),
    ("a = tstr .hex 'a'", '"61"', '"6"'), ("a = tstr .hexlc bytes", '"ab"', '"AB"'), ("a = tstr .hexuc bytes", '"AB"', '"ab"'), ("a = tstr .b32 'a'", '"ME"', '"ME======"'), ("a = tstr .h32 'a'", '"C4"', '"ME"'), ("a = tstr .b45 'AB'", '"BB8"', '"BB9"'),
    ("a = tstr .base10 42", '"42"', '"042"'), ('a = tstr .printf ["%04d %s %.2e", 7, "q", 1.5]', '"0007 q 1.50e+0"', '"7 q 1.50e+0"'), ("a = tstr .json {k: int}", '"{}"', '"1"'), ('a = tstr .join ["a", tstr, "c"]', '"abc"', '"ab"'),
    ("a = bytes .cbor int", "!", '"x"'), ("a = uri", '"http://x/"', '"x"'), ("a = tdate", '"2020-01-01T00:00:00Z"', '"2020-01-01"'),
]
CBOR = [
    ("a = #6.24(bytes .cbor int)", "d8184105", "d818426161", "05"), ("a = #6(tstr)", "c16161", "c101"), ("a = #(int)", "c101", "01"), ("a = #0.5", "05", "06"), ("a = #1.5", "24", "25"), ("a = #2.1", "4100", "40"),
    ("a = #4", "80", "a0"), ("a = #5.1", "a10102", "a0"), ("a = #7", "f90000", "00"), ("a = #7.22", "f7", "f5"), ("a = #7.25", "!", "f90000"), ("a = #7.255", "f8ff", "f8fe"), ("a = #", "00"),
    ("a = {1: int, ? 2: tstr}", "a10105", "a10205"), ("a = {* int => any, * bytes => any}", "a201004100f5", "a1616100"), ("a = bstr .cborseq [* int]", "420102", "4161"),
    ("a = biguint", "c24101", "c34101"), ("a = unsigned", "c24101", "20"), ("a = integer", "c34101", "f90000"), ("a = bigint", "c34101", "01"), ("a = decfrac", "c48201c24101", "c48101"),
    ("a = float16", "fb3ff199999999999a", "01"), ("a = null", "f7", "f5"), ("a = undefined", "!", "f7"), ("a = bytes .bits &(0, 9)", "420102", "420202"), ("a = uint .bitfield [3, 5]", "18ff", "190100"),
    ("a = [+ int]", "9f0102ff", "9fff"), ("a = tdate", "c074323032302d30312d30315430303a30303a30305a", "c06161"), ("a = encoded-cbor", "d8184100", "4100"), ("a = ~encoded-cbor", "4100", "00"), ("a = 'a'", "4161", "6161"),
    ("a = 1.5", "f93e00", "01"), ("a = {* 1..3 => int}", "a10100", "a10400"),
]


@pytest.mark.parametrize("case", JSON, ids=lambda c: c[0][:40])
def test_json(case):
    schema, good, *bad = case
    own = CDDL(schema, names=False)
    if not good.startswith("!"):
        assert own.check(good)[0] == "valid", own.check(good)
    for text in bad:
        status, issues = own.check(text)
        assert status == "mismatch" and issues, text


@pytest.mark.parametrize("case", CBOR, ids=lambda c: c[0][:40])
def test_cbor(case):
    schema, good, *bad = case
    own = CDDL(schema, names=False)
    if good != "!":
        assert own.check(bytes.fromhex(good))[0] == "valid", own.check(bytes.fromhex(good))
    for raw in bad:
        assert own.check(bytes.fromhex(raw))[0] == "mismatch", raw


@pytest.mark.parametrize(
    "schema, document, status",
    [
        ("a = [* int]", "[1", "malformedDocument"),
        ("a = tstr .abnf \"x\"", '"x"', "unsupported"),
        ("a = #6.1(int)", "1", "unsupported"),
        ("a = 1..\"x\"", "1", "invalidSchema"),
        ('a = tstr .regexp "("', '"x"', "invalidSchema"),
        ("a = tstr .cat 1", '"x"', "invalidSchema"),
    ],
)
def test_other_statuses(schema, document, status):
    found, issues = CDDL(schema, names=False).check(document)
    assert found == status and [i.kind for i in issues] == [status]


def test_issues_name_places_once():
    status, issues = CDDL("a = { p: [* {q: int}], ? r: tstr }").check('{"p":[{"q":1},{"q":"x"}],"r":1,"s":0}')
    assert status == "mismatch" and [i.path for i in issues][-1] == "/s" and "/r" in [i.path for i in issues]
    assert any(i.path.startswith("/p/1") for i in issues)
    raw = cbor.encode(cbor.item_of({"fee": "x"}))
    assert [i.path for i in CDDL("a = {fee: uint}").check(raw)[1]] == ['/"fee"']
    assert all(i.multi_type_choice for i in CDDL("a = 1 / 2").check("3")[1])


def test_limits():
    deep = CDDL("a = [? a]")
    assert deep.check("[" * 60 + "]" * 60)[0] == "valid"
    assert deep.check("[" * 60 + "]" * 60, options=Options(max_depth=50))[0] == "unsupported"
    assert deep.check("[" * 60 + "]" * 60, options=Options(max_work=20))[0] == "unsupported"
    raw = cbor.encode(cbor.item_of(1))
    for _ in range(20):
        raw = cbor.encode(cbor.item_of(raw))
    assert CDDL("a = int / bytes .cbor a").check(raw)[0] == "unsupported"
    _, issues = CDDL("a = [* {q: int}]").check("[" + ",".join(['{"q":"x"}'] * 500) + "]", options=Options(max_report=200))
    assert issues


def test_strict_options():
    strict = Options(strict=True)
    assert CDDL("a = float16").check(bytes.fromhex("fb3ff199999999999a"), options=strict)[0] == "mismatch"
    assert CDDL("a = undefined").check(bytes.fromhex("f7"), options=strict)[0] == "valid"
    assert CDDL("a = #1.5").check(bytes.fromhex("25"), options=strict)[0] == "valid"


@pytest.mark.parametrize("schema", ["a = {* tstr => int / tstr}", "a = [* (int, tstr)]", "a = {k: 1..5, ? s: tstr}", "a = [? int, * tstr]", "a = int / [* a]", "a = {* tstr => a} / uint"])
@pytest.mark.parametrize("value", [{}, {"k": 3}, {"k": 9, "s": "x"}, {"k": 1, "s": 2}, [], [1, "x"], [1, "x", 2], ["x", "y"], [[1], []], 5, {"a": {"b": 7}}])
def test_models_agree(schema, value):
    import json

    own = CDDL(schema)
    assert own.check(json.dumps(value))[0] == own.check(cbor.encode(cbor.item_of(value)))[0]


@pytest.mark.parametrize("schema, start, end", [("a = [* a]", "[", "]"), ("a = {? k: a}", '{"k":', "}"), ("a = {(k: a // z: int)}", '{"k":', "}"), ("a = {~m} / {}\nm = {k: a}", '{"k":', "}"), ("a = [g] / [] \ng = (a)", "[", "]")])
def test_depth_up_to_the_limit(schema, start, end):
    own, inner = CDDL(schema), {"]": "[]", "}": '{"z":1}' if "z" in schema else "{}"}[end]
    for n, status in ((12_000, "valid"), (16_380, "valid"), (16_400, "unsupported")):
        assert own.check(start * n + inner + end * n)[0] == status


@pytest.mark.parametrize(
    "control, pattern, text, status",
    [
        ("regexp", "^[a-z]+$", "abc\n", "mismatch"), ("regexp", "a.c", "a\rc", "valid"), ("regexp", "a.c", "a\nc", "mismatch"), ("regexp", "(?m)^b$", "a\nb\n", "valid"), ("regexp", "^[]$]+$", "]$\n", "mismatch"),
        ("regexp", "^[]$]+$", "]$", "valid"), ("regexp", r"^did\\:\\d+$", "did:42", "valid"), ("regexp", r"^\\w$", "w", "valid"), ("regexp", r"^\\w$", "x", "mismatch"), ("regexp", r"[\\i]", "i", "valid"), ("regexp", "(?=x)", "x", "invalidSchema"),
        ("iregexp", r"\\p{L}+", "añ漢", "valid"), ("iregexp", r"\\p{L}+", "a1", "mismatch"), ("pcre", r"(?<a_b>x)\\k<a_b>", "xx", "valid"), ("pcre", r"(?P<a_b>x)(?P=a_b)", "xy", "mismatch"), ("pcre", r"\\w+", "ab", "valid"), ("pcre", "a$", "a\n", "mismatch"),
    ],
)
def test_patterns(control, pattern, text, status):
    import json

    assert CDDL(f'a = tstr .{control} "{pattern}"').check(json.dumps(text))[0] == status
