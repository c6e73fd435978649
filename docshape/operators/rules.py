"""A schema's rules and references as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..syntax import ast
from ..syntax.names import references
from .validate import CDDL


def _tree(schema: CDDL | str) -> ast.Schema:
    return (schema if isinstance(schema, CDDL) else CDDL(schema, names=False)).tree


def rule_table(spark: SparkSession, schema: CDDL | str) -> DataFrame:
    """``(rule_ix, name, socket, kind, op, params, line)``."""
    rows = [(k, r.name.key, r.name.socket, "type" if r.is_type else "group", r.op, r.params, r.line) for k, r in enumerate(_tree(schema).rules)]
    return spark.createDataFrame(rows, "rule_ix int, name string, socket string, kind string, op string, params array<string>, line int")


def reference_table(spark: SparkSession, schema: CDDL | str) -> DataFrame:
    """``(ref_ix, rule, name, socket, is_param, pos)``, in order."""
    rows = [(k, r.name.key, n.key, n.socket, n.ident in r.params, n.pos) for k, (r, n) in enumerate(references(_tree(schema)))]
    return spark.createDataFrame(rows, "ref_ix int, rule string, name string, socket string, is_param boolean, pos int")


def undefined_names(rules: DataFrame, refs: DataFrame) -> DataFrame:
    """References that no rule, parameter, prelude name or socket explains, in order."""
    open_refs = refs.where("socket = '' and not is_param").where(~F.col("name").isin(ast.PRELUDE))
    return open_refs.join(rules.select("name").distinct(), "name", "left_anti").select("ref_ix", "rule", "name", "pos").orderBy("ref_ix")


def duplicate_rules(rules: DataFrame) -> DataFrame:
    """Plain definitions after any definition of their name."""
    place = F.row_number().over(Window.partitionBy("name").orderBy("rule_ix"))
    return rules.withColumn("nth", place).where("op = '=' and nth > 1").select("rule_ix", "name", "line")
