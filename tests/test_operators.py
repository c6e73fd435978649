import json
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docshape import queries as engine
from docshape.functions import cbor_decode_json, cbor_encode, json_compact
from docshape.functions.codecs import _encoded
from docshape.interp.quick import compile_quick
from docshape.model import cbor
from docshape.model.nodes import Item
from docshape.operators import CDDL, Options, decode_nodes, validate
from docshape.operators import is_valid
from docshape.plans.json import compile_json
from docshape.plans import NotCompilable, compile_rule, matches
from docshape.sources import read_cbor, read_cbor_hex, read_json_documents, read_schema, write_verdicts
from docshape.syntax import parse
from docshape.streaming import issue_counts, validate_stream, write_split

SF = "/root/testdata/sf0.001"


def test_null_and_malformed_documents(spark):
    df = spark.createDataFrame([(1, "[1]"), (2, None), (3, "["), (4, '["x"]')], "k int, doc string")
    rows = {r["k"]: r["verdict"] for r in validate(df, "a = [* int]", "doc").collect()}
    assert rows[1]["is_valid"] and rows[2] is None and rows[3]["status"] == "malformedDocument" and rows[4]["issues"][0]["path"] == "/0"
    assert validate(df.limit(0), "a = int", "doc").count() == 0


QUICK = [
    'o = { cust: uint .lt 700, status: "F" / "O" }', "o = { a: int, b: tstr }", 'o = { "a": int .ge -3, b: 1 / "x" / -2 }', "o = { a: uint .gt 5 / tstr }", "o = {}",
]


@pytest.mark.parametrize("schema", QUICK)
def test_plain_cbor_maps_need_no_walker(schema):
    """The quick test says what the walker says, or nothing; of plain maps it judges all."""
    rng, tree = random.Random(7), parse(schema)
    quick, told = compile_quick(tree, "o", Options()), 0
    names = [e.key.word or e.key.value.value for e in tree.rules[0].type.choices[0].base.group.choices[0]]
    values = [0, 1, -1, -2, -3, -4, 5, 6, 699, 700, 1 << 40, -(1 << 63), 1 << 70, "", "F", "O", "x", "é" * 300, b"F", None, True, 1.0, [1], {"a": 1}]
    for _ in range(600):
        plain = [(k, rng.choice(values[:12] + values[13:18])) for k in names]
        odd = [(rng.choice(["a", "b", "cust", "status", 1]), rng.choice(values)) for _ in range(rng.randrange(4))]
        document = cbor.encode(Item("map", [(cbor.item_of(k), cbor.item_of(v)) for k, v in (plain if rng.random() < 0.5 else odd if rng.random() < 0.3 else rng.sample(plain, len(plain)) + odd)], indefinite=rng.random() < 0.05))
        if rng.random() < 0.3:
            at = rng.randrange(len(document))
            document = rng.choice([document[:at], document + document[:at], document[:at] + bytes([rng.randrange(256)]) + document[at + 1 :]])
        found = quick(document)
        told += found is not None
        assert found is None or found == (CDDL(tree.source).check(document, "o")[0] == "valid"), document
    assert told > 150
    plain = [cbor.encode(cbor.item_of({k: v for k in names})) for v in (0, 699, -4, "F", "é" * 300)]
    assert None not in map(quick, plain)


@pytest.mark.parametrize("schema", ["o = { ? a: int }", "o = { a: int, * tstr => any }", "o = { a: float }", "o = { a: int }\no /= int", "o = { a: uint }\nuint = tstr", "o = { a: int, a: tstr }", "o = [ int ]", "o = { a: k }\nk = int", "o = { a => int }", "o = { a: uint .size 1 }"])
def test_other_rules_are_the_walkers(schema):
    assert compile_quick(parse(schema), "o", Options()) is None
    assert compile_quick(parse("o = { a: int }"), "o", Options(max_work=2)) is None


def test_cbor_encode_by_columns():
    """Encoding by columns gives the bytes of encoding by values."""
    rows = [{"i": k % 7 - 3 << k % 40, "s": None if k % 5 == 0 else "é" * (k % 30), "f": [0.0, -0.0, 1.5, None][k % 4], "n": None if k % 3 == 0 else {"b": k % 2 == 0, "l": [k]}} for k in range(300)]
    values = pa.array([*rows, None, rows[0]], pa.struct([("i", pa.int64()), ("s", pa.string()), ("f", pa.float64()), ("n", pa.struct([("b", pa.bool_()), ("l", pa.list_(pa.int32()))]))]))
    for own in (values, values[5:200], values[:0], *values.flatten()):
        assert _encoded(own).to_pylist() == [cbor.encode(cbor.item_of(v)) for v in own.to_pylist()]


TYPED = ["a = int", "a = uint .le 5", "a = {x: -2..3, ? s: tstr}", 'a = {x: int, s: "a" / "b"}', "a = {x: any, ? f: float .lt 1.0, ? s: tstr .size (1..2)}", "a = {x: int, ? l: [* 0..3], * tstr => any}", "a = {x: uint, l: [int, * uint]} / {x: nint}"]


@pytest.mark.parametrize("schema", TYPED)
def test_tiers_agree(spark, schema):
    rng = random.Random(7)
    rows = [
        (k, (rng.choice([None, -3, 0, 3, 9]), rng.choice([None, "a", "b", "xyz", ""]), rng.choice([None, 0.5, 1.0, float("nan")]), rng.choice([None, [], [1, 2], [-1, 3], [5]])))
        for k in range(120)
    ]
    df = spark.createDataFrame(rows, "k int, v struct<x:int,s:string,f:double,l:array<int>>")
    own = CDDL(schema)
    column, tier = matches(df, own, "v")
    if tier == "arrow":
        with pytest.raises(NotCompilable):
            compile_rule(own, "v", df.schema["v"].dataType)
    got = {r["k"]: r["ok"] for r in df.select("k", column.alias("ok")).collect()}
    for k, (x, s, f, items) in rows:
        from docshape.model import cbor

        value = {n: v for n, v in (("x", x), ("s", s), ("f", f), ("l", items)) if v is not None}
        assert got[k] == (own.check(cbor.encode(cbor.item_of(value)))[0] == "valid"), (value, schema)


def test_compiled_predicates_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/part.parquet")
    plan = df.where(compile_rule("p = uint .le 10", "p_size", df.schema["p_size"].dataType)).select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "p_size" in plan and "ArrowEvalPython" not in plan


def test_codecs_and_nodes(spark):
    df = spark.range(3).select("id", cbor_encode(F.struct(F.col("id").alias("n"), F.array(F.lit("é")).alias("l"))).alias("c"))
    assert [r[0] for r in df.select(cbor_decode_json("c")).collect()] == [f'{{"n":{k},"l":["é"]}}' for k in range(3)]
    nodes = decode_nodes(df, "id", "c").where("id = 1").orderBy("node_id").collect()
    assert [(n["role"], n["path"]) for n in nodes] == [("root", ""), ("key", '/"n"'), ("value", '/"n"'), ("key", '/"l"'), ("value", '/"l"'), ("item", '/"l"/0')]
    assert nodes[0]["end"] == nodes[-1]["end"] and all(n["complete"] for n in nodes)
    text = spark.createDataFrame([('{"b": 1.0, "a": 2, "a": 3}',), ("{",), (None,)], "t string")
    assert [r[0] for r in text.select(json_compact("t")).collect()] == ['{"a":3,"b":1.0}', None, None]


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "s.cddl").write_text("a = {k: uint}\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text("\n".join(json.dumps({"k": k - 1}) for k in range(4)))
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x.hex").write_text("a1 616b01\n")
    (tmp_path / "h" / "y.hex").write_text("abc")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.cbor").write_bytes(bytes.fromhex("a1616b01"))
    schema = read_schema(spark, str(tmp_path / "s.cddl"))
    assert validate(read_cbor(spark, str(tmp_path / "c")), schema, "document", model="cbor").first()["verdict"]["is_valid"]
    assert sorted(str(r["verdict"] and r["verdict"]["is_valid"]) for r in validate(read_cbor_hex(spark, str(tmp_path / "h")), schema, "document", model="cbor").collect()) == ["None", "True"]
    docs = validate(read_json_documents(spark, str(tmp_path / "d")), schema, "document")
    write_verdicts(docs, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 1
    stream = spark.readStream.schema("value string").text(str(tmp_path / "d"))
    judged = validate_stream(stream, schema, "value")
    write_split(judged, str(tmp_path / "sg"), str(tmp_path / "sb"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "sg")).count() == 3 and spark.read.parquet(str(tmp_path / "sb")).count() == 1
    assert issue_counts(judged.withColumn("ts", F.current_timestamp()), "ts").isStreaming


JSON_RULES = [
    "a = int", "a = uint .le 5 / float", "a = {x: -2..3, ? s: tstr}", 'a = {x: int, s: "a" / "b" // x: nint}', "a = {x: any, ? f: float .lt 1.0, ? s: tstr .size (1..2)}", "a = [* 0..3]", "a = [int, * tstr]", "a = [2*3 number]",
    "a = {~b, $$c}\nb = {? x: int}\n$$c //= (? s: tstr)\n$$c //= (f: float)", 'a = {? "x" => uint, l: [* {k: 1.5 / nil / true}]}', "a = {g}\ng = (x: int // s: tstr)", "a = {x: t<int>}\nt<v> = [* v] / v", 'a = tstr .regexp "^[ab]+$"', "a = any", "a = {}", "a = []",
]


@pytest.mark.parametrize("schema", JSON_RULES)
def test_json_expressions_agree_with_the_walker(spark, schema):
    """Random documents, and texts that two readers of JSON might take differently: sure answers are right ones."""
    rng = random.Random(schema)
    scalars = ["0", "-0", "1", "-3", "2.0", "0.5", "1e2", "1E400", "30.0", "12345678901234567890", "123456789012345678.0", "1234567890123456789.0", '"a"', '"xyz"', '"\\u0041"', '"é]"', "null", "true", "false", "01", "", "nul"]

    def value(depth):
        kind = rng.randrange(4 if depth else 2)
        if kind < 2:
            return rng.choice(scalars)
        if kind == 2:
            return "[" + rng.choice([",", ", "]).join(value(depth - 1) for _ in range(rng.randrange(4))) + "]"
        return "{" + ",".join(f'"{rng.choice("xsflkxx")}":{value(depth - 1)}' for _ in range(rng.randrange(4))) + "}"

    texts = [value(3) for _ in range(500)] + [t + x for t in ("{}", "[]", "1", '{"x":1}') for x in (" ", " x", "}", "]", ",1", '],["', "],[2", '},{"":2', ',"":2')]
    texts += [f'{{"x":{x},"s":{s}}}' for x in scalars for s in ('"a"', "1")] + [f'{{"x":{x}}}' for x in scalars] + [f"[{x},{y}]" for x in scalars for y in scalars[:14]]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "k int, doc string")
    own = CDDL(schema)
    got = {r["k"]: (r["fast"], r["ok"]) for r in df.select("k", compile_json(own, "doc").alias("fast"), is_valid(own, "doc").alias("ok")).collect()}
    sure = 0
    for k, text in enumerate(texts):
        want = own.check(text)[0] == "valid"
        assert got[k][1] == want and got[k][0] in (None, want), (text, got[k], own.check(text))
        sure += got[k][0] is not None
    assert got[len(texts)] == (None, None) and sure > len(texts) / 4


def test_valid_json_needs_no_walker(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").select(compile_json("p = { k: uint }", "props").alias("ok"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString() and df.where("ok is null").count() == 0


@pytest.mark.parametrize("name", ["q01_map_closed", "q06_size_text", "q13_array_len", "q15_sequence", "q20_assignment", "q24_tagged", "q36_noncanonical", "q36_flags_by_window", "q38_duplicate_rules", "q42_ledger_classify", "q43_limits", "q45_deep", "q52_issue_in_array", "q52_issues_of_members"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "customer", "part", "orders", "lineitem", "events", "embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = engine.queries()[name](spark, SF)
    want = con.sql(engine.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [list(want.columns).index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[k] for k in order) for r in want.fetchall())


def test_every_query_plans(spark):
    for name, query in engine.queries().items():
        assert query(spark, SF).columns, name


def test_spread_deals_rows_not_splits(spark, monkeypatch):
    """Rows of one crowded split go to all tasks, and to more tasks as they grow."""
    from docshape import sources

    monkeypatch.setattr(sources, "ROWS", 1000)
    crowded = spark.range(0, 40_000, 1, 16).where("id < 2500").union(spark.range(30_000, 50_000, 1, 1))  # 17 splits
    sizes = [r["n"] for r in sources.spread(crowded).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 23 and sum(sizes) == 22_500 and max(sizes) < 1500


def test_repeated_documents_are_judged_once(spark):
    import pyarrow as pa
    from docshape.operators import classify_ledger
    from docshape.operators.repeats import MOST, different, recalled

    values, first, place = different(pa.array(["b", None, "a", "b"]))
    assert values.to_pylist() == ["b", "a"] and first.tolist() == [0, 2] and place.to_pylist() == [0, None, 1, 0]
    calls, known = [], {}
    for k in [1, 2, 1, *range(MOST + 5), 1]:
        assert recalled(known, f"{k}", lambda: calls.append(k) or k * 2) == k * 2  # noqa: B023
    assert calls[:2] == [1, 2] and calls[2] == 0 and len(known) <= MOST
    schema, texts = CDDL('p = { a: 1..3, ? b: "x" }'), ['{"a":1}', '{"a":9,"b":"y"}', "{", None, '{"b":"x","a":2}', '{"a":01}', '{"a":1,"a":7}', "[1]"]
    for rows in (texts, texts * 40):  # below and above the share at which they are asked for first
        df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").coalesce(1)
        for r in validate(df, schema, "t").withColumn("ok", is_valid(schema, "t")).collect():
            want = (None, None) if r["t"] is None else schema.check(r["t"])
            got = (None, None) if r["verdict"] is None else (r["verdict"]["status"], r["verdict"]["issues"])
            assert got[0] == want[0] and r["ok"] == (None if r["t"] is None else want[0] == "valid")
            assert want[1] is None or [tuple(i) for i in got[1]] == [tuple(vars(i).values()) for i in want[1]]
    df = spark.createDataFrame([(bytes([k % 3]) if k % 4 else None,) for k in range(100)], "t binary")
    assert {(None if r["t"] is None else r["t"][0], r["ledger"] and r["ledger"]["status"]) for r in classify_ledger(df, "transaction = 0 / 2", "t").collect()} == {(None, None), (0, "valid"), (1, "mismatch"), (2, "valid")}


@pytest.mark.parametrize("name", ["q36_items_at", "q36_items_of_issues"])
def test_node_tables_are_not_broadcast(spark, name):
    plan = engine.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["q43_work", "q43_limits", "q42_ledger_classify", "q36_items_of_issues", "q52_choice_flags", "q23_typed_struct", "q33_issues_by_path", "q36_items_at"])
def test_document_queries_deal_their_rows(spark, name):
    plan = engine.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


@pytest.mark.parametrize("few", [None, 0])
def test_few_documents_are_judged_apart_from_their_rows(spark, monkeypatch, few):
    """The same rows whether documents are broadcast or their rows are dealt; nulls have none."""
    from docshape import sources
    from docshape.operators.issues import explode_issues

    if few is not None:
        monkeypatch.setattr(sources, "FEW", few)
    schema, texts = CDDL('p = { a: 1..3, ? b: "x" }'), ['{"a":1}', '{"a":9,"b":"y"}', "{", None, '{"b":"x","a":2}', '{"a":1,"a":7}', "[1]"]
    df = spark.createDataFrame([(k, k % 5 if k % 7 else None, texts[k % 7]) for k in range(300)], "k int, x int, t string")
    got = sources.by_document(df, "t", lambda d, keys: explode_issues(validate(d, schema, "t"), keys))
    assert got.columns[:4] == ["k", "x", "t", "ord"] and ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == (few is None)
    want = [(k, k % 5 if k % 7 else None, texts[k % 7], i, *vars(x).values()) for k in range(300) if texts[k % 7] is not None for i, x in enumerate(schema.check(texts[k % 7])[1])]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["q34_report_topk", "q52_issue_in_array"])
def test_rows_of_few_documents_stay_in_the_jvm(spark, name):
    """Python is below the broadcast only: rows are neither dealt for it nor sent to it."""
    plan = engine.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and "Python" not in plan.split("Join")[0] and "collect_list" not in plan


@pytest.mark.parametrize("few", [None, 0])
@pytest.mark.parametrize("name", ["q33_issues_by_path", "q34_report_topk", "q16_int_vs_float", "q21_unwrap"])
def test_few_documents_give_what_the_sql_gives(spark, monkeypatch, name, few):
    from docshape import sources

    if few is not None:
        monkeypatch.setattr(sources, "FEW", few)
    test_queries_match_their_sql(spark, name)


@pytest.mark.parametrize("few", [None, 0])
def test_counts_judge_each_document_once(spark, monkeypatch, few):
    """Few documents come once with their rows' number, others as they are; the sums are the same."""
    from docshape import sources
    from docshape.operators import issues_by_path

    if few is not None:
        monkeypatch.setattr(sources, "FEW", few)
    df = spark.createDataFrame([(t,) for t in ['{"a":1}', '{"a":9}', "{", None] * 100 + ['{"a":8}']], "t string")
    docs = sources.weighed(df, "t", "n")
    assert sorted(r["n"] for r in docs.collect()) == ([1, 100, 100, 100, 100] if few is None else [1] * 401)
    got = {(r["path"], r["kind"]): r["n_issues"] for r in issues_by_path(validate(docs, "p = { a: 1..3 }", "t"), weight="n").collect()}
    assert got == {("/a", "mismatch"): 101, ("", "malformedDocument"): 100}
    plan = engine.queries()["q16_int_vs_float"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == (2 if few is None else 1)


def test_lines_are_counted_with_and_without_numbers(spark, tmp_path):
    """q52_issue_in_array counts rows as its SQL does, also where line numbers are null."""
    spark.createDataFrame([(k, None if i % 2 else i) for k in range(6) for i in range(k)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = engine.queries()["q52_issue_in_array"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(4, "/3/n"), (5, "/3/n")]
