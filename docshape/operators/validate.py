"""Validation of a column of documents.

Validation is narrow: no shuffle, and only the document column crosses to Python, in Arrow batches.
Schemas travel as text and are parsed once per worker.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..interp.quick import Quick, compile_quick
from ..interp.walk import Index, Issue, Options, validate_item
from ..model import cbor, jsontext
from ..model.nodes import Item
from ..syntax import format_schema, parse
from ..syntax.names import checked
from .repeats import different, memory, often, recalled

_ISSUE = "path string, reason string, kind string, multi_type_choice boolean, multi_group_choice boolean, group_to_choice boolean, entry_rule string"
VERDICT = f"is_valid boolean, status string, issues array<struct<{', '.join(p.replace(' ', ':', 1) for p in _ISSUE.split(', '))}>>"
_ARROW_ISSUE = pa.struct([(n, pa.bool_() if t == "boolean" else pa.string()) for n, t in (p.split() for p in _ISSUE.split(", "))])
_ARROW_VERDICT = pa.struct([("is_valid", pa.bool_()), ("status", pa.string()), ("issues", pa.list_(_ARROW_ISSUE))])
_ISSUES = VERDICT.split("issues ", 1)[1]
#: Fixed value: a verdict with more issues is not remembered.
_FEW = 4
MODELS = ("json", "cbor", "cborseq")


class CDDL:
    """A schema: its text, checked.  ``names=False`` leaves the names' checks out."""

    def __init__(self, text: str | bytes, names: bool = True):
        self.tree = parse(text)
        if names:
            checked(self.tree)
        self.text = self.tree.source

    def root(self, rule: str | None = None) -> str:
        return self.tree.root(rule)

    def formatted(self) -> str:
        return format_schema(self.tree)

    def check(self, document: str | bytes, rule: str | None = None, model: str | None = None, options: Options = Options()) -> tuple[str, list[Issue]]:
        """Status and issues of one document, on the driver."""
        return check(Index(self.tree), self.root(rule), document, model or ("json" if isinstance(document, str) else "cbor"), options)


@lru_cache(maxsize=64)
def _index(text: str) -> Index:
    return Index(parse(text))


@lru_cache(maxsize=64)
def _quick(text: str, root: str, model: str, options: Options) -> Quick | None:
    return compile_quick(parse(text), root, options) if model == "cbor" else None


def read_document(document: str | bytes, model: str) -> Item:
    """The item that a document is.  Raises JSONError or CBORError."""
    if model == "json":
        return jsontext.parse(document if isinstance(document, str) else document.decode("utf-8"))
    return cbor.decode(document) if model == "cbor" else Item("array", cbor.decode_sequence(document))


def check(index: Index, rule: str, document: str | bytes, model: str, options: Options, issues: bool = True, failed: bool = False) -> tuple[str, list[Issue]]:
    try:
        item = read_document(document, model)
    except ValueError as e:
        return "malformedDocument", [Issue("", str(e), "malformedDocument")]
    return validate_item(index, rule, item, "json" if model == "json" else "cbor", options, issues, failed)


def _prepared(schema: CDDL | str, rule: str | None, model: str) -> tuple[str, str]:
    if model not in MODELS:
        raise ValueError(f"model is one of {', '.join(MODELS)}")
    own = schema if isinstance(schema, CDDL) else CDDL(schema)
    return own.text, own.root(rule)


def validate(
    df: DataFrame, schema: CDDL | str, column: str, *, rule: str | None = None, model: str = "json", options: Options = Options(), output: str = "verdict"
) -> DataFrame:
    """``df`` with a verdict column: is_valid, status and issues of each document.

    ``model`` is json (text), cbor or cborseq (bytes).  A null document has a null verdict.  A
    document that can't be read has status malformedDocument; a schema fault or a breached limit is
    the whole report of its document.
    """
    text, root = _prepared(schema, rule, model)

    def found(documents: pa.Array, failed: pa.Array | None, frequent: bool = False) -> pa.Array:
        """Verdicts of a batch; of a batch with few repeated documents none, if only ``frequent`` ones are asked for."""
        values, first, place = different(documents)
        if frequent and not often(documents, values):
            return pa.nulls(len(documents), _ARROW_VERDICT)
        index, known = _index(text), memory("verdict", text, root, model, options)
        flags = [False] * len(values) if failed is None else failed.take(pa.array(first)).to_pylist()

        def one(document: str | bytes, flag: bool) -> dict:
            status, issues = check(index, root, document, model, options, failed=flag)
            return {"is_valid": status == "valid", "status": status, "issues": [vars(i) for i in issues]}

        own = [recalled(known, d, lambda: one(d, f), lambda out: len(out["issues"]) <= _FEW) for d, f in zip(values.to_pylist(), flags)]  # noqa: B023
        return pa.array(own, _ARROW_VERDICT).take(place)

    kind = f"struct<{VERDICT.replace(' boolean', ':boolean').replace(' string', ':string').replace(' array', ':array')}>"

    @F.arrow_udf(kind)
    def verdict(documents: pa.Array, failed: pa.Array) -> pa.Array:
        return found(documents, failed)

    @F.arrow_udf(kind)
    def frequent(documents: pa.Array) -> pa.Array:
        return found(documents, None, True)

    # so that filters on the verdict, also those that Spark infers, don't walk every document again below it
    verdict, frequent = verdict.asNondeterministic(), frequent.asNondeterministic()
    fast = _compiled(schema, column, rule, model, options)
    if fast is None:
        return df.withColumn(output, verdict(F.col(column), F.lit(False)))
    # where documents come often, asking for their verdicts costs less than the expression
    known, told = f"{output} known", f"{output} told"
    own = df.withColumn(known, frequent(F.col(column))).withColumn(told, F.when(F.col(f"`{known}`").isNull(), fast))
    # what surely matches needs no walker: it gets no text
    doubtful = F.when(F.col(f"`{known}`").isNull() & ~F.coalesce(F.col(f"`{told}`"), F.lit(False)), F.col(column))
    valid = F.struct(F.lit(True).alias("is_valid"), F.lit("valid").alias("status"), F.array().cast(_ISSUES).alias("issues"))
    judged = F.coalesce(F.col(f"`{known}`"), verdict(doubtful, F.col(f"`{told}`").isNotNull()), F.when(F.col(column).isNotNull(), valid))
    return own.withColumn(output, judged).drop(known, told)


def _compiled(schema: CDDL | str, column: str | Column, rule: str | None, model: str, options: Options) -> Column | None:
    """The rule as an expression over JSON text, NULL where only the walker can tell; None if it has none."""
    if model != "json":
        return None
    from ..plans.compile import NotCompilable
    from ..plans.json import compile_json

    try:
        return compile_json(schema, column, rule=rule, options=options)
    except NotCompilable:
        return None


def is_valid(schema: CDDL | str, column: str | Column, *, rule: str | None = None, model: str = "json", options: Options = Options()) -> Column:
    """Whether documents match, without issues: a boolean column for filters and aggregates."""
    text, root = _prepared(schema, rule, model)

    def found(documents: pa.Array, frequent: bool = False) -> pa.Array:
        values, _, place = different(documents)
        if frequent and not often(documents, values):
            return pa.nulls(len(documents), pa.bool_())
        index, known = _index(text), memory("valid", text, root, model, options)
        documents, quick = values.to_pylist(), _quick(text, root, model, options)
        own = [quick(d) for d in documents] if quick else [None] * len(documents)
        for k, d in enumerate(documents):
            if own[k] is None:
                own[k] = recalled(known, d, lambda: check(index, root, d, model, options, False)[0] == "valid")  # noqa: B023
        return pa.array(own, pa.bool_()).take(place)

    @F.arrow_udf("boolean")
    def matches(documents: pa.Array) -> pa.Array:
        return found(documents)

    @F.arrow_udf("boolean")
    def frequent(documents: pa.Array) -> pa.Array:
        return found(documents, True)

    @F.arrow_udf("boolean")
    def told_or_matches(rows: pa.Array) -> pa.Array:
        return pc.coalesce(rows.field("told"), found(rows.field("document")))

    from ..plans.json import _let

    documents = F.col(column) if isinstance(column, str) else column
    fast = _compiled(schema, documents, rule, model, options)
    if fast is None:
        return matches(documents)
    # where documents come often, asking for their results costs less than the expression, which is computed once
    rows = F.struct(F.coalesce(frequent(documents), fast).alias("told"), documents.alias("document"))
    return told_or_matches(_let(rows, lambda x: F.struct(x["told"].alias("told"), F.when(x["told"].isNull(), x["document"]).alias("document"))))
