import pytest

from docshape.operators import CDDL
from docshape.syntax import ParseError, SchemaError, ast, duplicate_definitions, format_schema, parse, undefined_references

GOOD = [
    "",
    "a = int",
    "a = 1 / 2 / 3",
    "a = [1*2 int, *tstr, + bool, ? nil, 3* any, *4 uint]",
    'a = { ? "k" => int, b: tstr, 1: bool, * tstr ^ => any, (c: int // d: int) }',
    "a = #6.32(tstr) / #0.5 / #7 / # / #(int) / #6.<b>(tstr)\nb = uint",
    "a = ~b / &(x: 1, y: 2) / &c\nb = [int]\nc = (1, 2)",
    "p<t, u> = [t, u]\na = p<int, (1 / 2)>",
    "a = $s\n$s /= int\n$s /= tstr\nb = { * $$g }\n$$g //= (k: int)",
    "a = 0x1F..0b101 / 1.5...2.5e3 / -1..1 / 0x1.8p3",
    'a = "x\\n\\u00e9\\u{1F600}\\ud83d\\ude00" / h\'00 ff\' / b64\'AAE\' / \'raw\'',
    "a = tstr .regexp \"x\" / (uint .size (1..4)) / bytes .cborseq [* int]",
    "a = (b / c) / d\nb = (int)\nc = 1\nd = 2",
    "; only a comment",
    "a = [[[[[[[[[[[[int]]]]]]]]]]]]",
    "a = ((((((((((((((((int))))))))))))))))",
]


@pytest.mark.parametrize("text", GOOD)
def test_format_is_a_fixed_point_and_keeps_the_tree(text):
    tree = parse(text)
    once = format_schema(tree)
    assert parse(once) == tree
    assert format_schema(parse(once)) == once


@pytest.mark.parametrize("text", ["a =", "a = {", "a = [int", "= int", 'a = "x', "a = int,", "a = { k ^ : int }", "a = 18446744073709551616", "a = /", "a = { x? : int }", 'a = "\\ud800"'])
def test_syntax_errors(text):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert e.value.line == 1 and e.value.column >= 1


def test_errors_tell_the_place():
    with pytest.raises(ParseError) as e:
        parse("a = int\nb = { k: }\n")
    assert (e.value.line, e.value.column) == (2, 10)
    with pytest.raises(ParseError):
        parse(b"a = \xff")


def test_comments_stay():
    text = "; first\na = int ; behind\n; before b\nb = [\n; inside\n* a]\n; last\n"
    once = format_schema(parse(text))
    assert [line for line in once.splitlines() if ";" in line] == ["; first", "a = int ; behind", "; before b", "; inside", "; last"]
    assert format_schema(parse(once)) == once
    assert parse('a = ";no comment"').comments == []


def test_names():
    loose = parse("a = b / uint\na = c<d>\nc<t> = [t, $s, e]")
    assert [n.key for _, n in undefined_references(loose)] == ["b", "d", "e"]
    assert [r.line for r in duplicate_definitions(loose)] == [2]
    for text in ("a = b", "a = int\na = tstr"):
        with pytest.raises(SchemaError):
            CDDL(text)
    CDDL("a = b", names=False)
    assert parse("g<t> = t\na = g<int>").root() == "a"


def test_literals():
    def value(text):
        return parse(f"a = {text}").rules[0].type.choices[0].base

    assert value("0x10").value == 16 and value("0b11").value == 3 and value("-7").value == -7 and value("0x1.8p1").value == 3.0
    assert value("h'0aFF'") == ast.Value("bytes", b"\x0a\xff") and value("b64'AAE='").value == b"\x00\x01"
    assert value('"\\u{1F600}"').value == "\U0001f600"


def test_deep_nesting_parses_in_linear_time():
    assert len(list(parse("a = " + "[" * 200 + "int" + "]" * 200).walk())) > 600
    parse("a = " + "[(" * 40 + "int" + ")]" * 40)
