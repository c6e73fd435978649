"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every text (each version of a path) is addressed by its SHA-256: a blob.  The ledger holds one
row for each blob and rule version that was scanned, with the spans found, none included.
A scan looks only at pairs of blob and rule version that the ledger lacks, each blob once however
many paths hold it; findings then join back to all paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import materialize

#: Unseen addresses are broadcast to pick texts if they are at most so many, and at most this share of all:
#: with more of them there is little that could stay where it is.
BROADCAST_BLOBS, BROADCAST_SHARE = 100_000, 0.25
SPANS = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches, and how long a match's ``group`` must be to count.

    ``hints`` (in lower case; one must be in the lower-cased text) or ``probe`` (one search) tell
    cheaply that a text has no match that counts.  A changed rule needs a new version.
    """

    kind: str
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()
    probe: str = ""
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order in which spans that start together are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]+", 0, 24, probe="[0-9a-f]{24}"),
)


def spans(text: Column, rule: Rule) -> Column:
    """Spans (code points, end exclusive) of a rule's matches, leftmost and non-overlapping.

    The texts between matches and the matches alternate, so that running sums of their lengths
    give the matches' places.
    """
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    lengths = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, F.length).alias("part"))

    def step(state: Column, row: Column) -> Column:
        begin = state["at"] + row["gap"]
        end = begin + F.coalesce(row["size"], F.lit(0))
        found = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(row["part"] >= rule.least, F.concat(state["found"], found)).otherwise(state["found"]).alias("found"))

    searched = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found")), step, lambda s: s["found"])
    hinted = F.lit(not rule.hints)
    for hint in rule.hints:
        hinted = hinted | F.lower(text).contains(hint)
    if rule.probe:
        hinted = hinted & text.rlike(rule.probe)
    return F.when(hinted, searched).otherwise(F.array().cast(SPANS))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).selectExpr("cast(null as string) blob", "cast(null as string) rule", f"cast(null as {SPANS}) spans")


def scan(spark: SparkSession, texts: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows ``(blob, rule, spans)`` for what ``ledger`` lacks.

    ``texts`` has (blob, text), a row for each path and version.  Only addresses meet the ledger.  Where
    few are unseen (``BROADCAST_BLOBS``, ``BROADCAST_SHARE``) these pick their texts where they are read, and
    seen texts don't move; else each text is shuffled once, by its address; copies collapse before that.
    """
    keys = [r.key for r in rules]
    seen = ledger.where(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    every = texts.select("blob").distinct().join(seen, "blob", "left")
    every = every.select("blob", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    every = materialize(spark, every, "secret-addresses")
    todo = every.where(F.size("todo") > 0)
    count = every.agg(F.count("*").alias("n"), F.count_if(F.size("todo") > 0).alias("unseen")).first()
    few = count["unseen"] <= min(BROADCAST_BLOBS, BROADCAST_SHARE * count["n"])
    picked = texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi") if few else texts
    unseen = picked.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    found = F.array(*[F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), spans(F.col("text"), r).alias("spans"))) for r in rules])
    rows = unseen.select("blob", F.explode(found).alias("f")).where("f is not null")
    return rows.select("blob", "f.rule", "f.spans")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``, one row for each blob and rule version; empty where there is none.

    Writers append, and a retried or second writer may append a pair again: equal pairs have equal spans.
    """
    try:
        return spark.read.schema(empty_ledger(spark).schema).parquet(path).dropDuplicates(["blob", "rule"])
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty_ledger(spark)


def update(spark: SparkSession, texts: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger at ``path`` (a folder that all executors share) up to date and read it."""
    scan(spark, texts, read_ledger(spark, path), rules).write.mode("append").option("compression", "zstd").parquet(path)
    return read_ledger(spark, path)


def addressed(docs: DataFrame) -> DataFrame:
    """``(doc_id, blob, text)``; a null text is the empty blob."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", F.sha2("text", 256).alias("blob"), "text")


_FOUND = "array<struct<start:int,rank:int,end:int,kind:string>>"


def by_blob(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(blob, spans)`` of the blobs with findings by these rule versions: an array of
    (start, rank, end, kind), by start and then in the order of the rules."""
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
    hit = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).select("blob", "rule", F.explode("spans").alias("s"))
    hit = hit.select("blob", F.struct(F.col("s.start").alias("start"), rank[F.col("rule")].alias("rank"), F.col("s.end").alias("end"), kind[F.col("rule")].alias("kind")).alias("s"))
    return hit.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def joined(texts: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(doc_id, blob, spans)``: the ledger's findings at every path of ``texts`` (doc_id, blob); no text moves."""
    found = by_blob(ledger, rules)
    return texts.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_FOUND)).alias("spans"))


def findings(spark: SparkSession, docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(doc_id, blob, spans)``, one row for each row of ``docs``: all spans of all rules.

    ``ledger`` holds earlier scans; only what it lacks is scanned.  Repeated rows and rows with a
    null doc_id get results like any other; a null or empty text has no spans; other columns are
    not read; an empty table gives an empty result.
    """
    texts = addressed(docs)
    old = ledger if ledger is not None else empty_ledger(spark)
    new = materialize(spark, scan(spark, texts.select("blob", "text"), old, rules), "secret-ledger")
    return joined(texts, new if ledger is None else new.unionByName(ledger.select("blob", "rule", "spans")), rules)


def history(spark: SparkSession, loads: Sequence[DataFrame], path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``findings`` of the last of several loads, each a snapshot (doc_id, text) of all paths at its time.

    The ledger at ``path`` keeps every version that any load held: a load scans only blobs that no
    earlier one had.
    """
    for docs in loads:
        update(spark, addressed(docs).select("blob", "text"), path, rules)
    return joined(addressed(loads[-1]), read_ledger(spark, path), rules)
