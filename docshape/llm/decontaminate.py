"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

The index holds a posting (term, document, position) for every place of the corpus that has a
term of the benchmark, written once.  A window of an item (13 consecutive words) is looked up
from its rarest term: each posting of it gives one offset between item and document.  The posting
lists of the words around, shifted by that offset, are intersected with it, and runs of matches as
long as a window are exact phrase matches.

The vocabulary is broadcast after a check of its size; it grows with the benchmark, not with the
corpus.  A larger one is joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import materialize

WINDOW = 13
#: Distinct benchmark terms up to which the vocabulary is broadcast.
BROADCAST_TERMS = 2_000_000
#: Everything that separates words, once A-Z are lower-cased.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """A text's words: runs of digits, letters a-z (A-Z lower-cased) and code points from U+0080."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _SEPARATORS, -1), "")


def item_words(items: DataFrame) -> DataFrame:
    """``(item, item_id, term, j, size)`` of a benchmark; ``item`` tells rows of one item_id apart."""
    base = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    split = base.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words_of(F.col("text")).alias("w"))
    return split.select("item", "item_id", F.size("w").alias("size"), F.posexplode("w").alias("j", "term"))


def build_index(spark: SparkSession, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Write the postings ``(tid, doc_id, mark, pos)`` of ``terms`` (term, tid) and read them.

    Each document also gets one posting with a null tid, whose position is its number of words.  ``mark``
    tells rows of one doc_id apart.
    """
    n = terms.count()
    table = terms.select("term", "tid").unionByName(spark.range(1).selectExpr("'' term", "cast(null as bigint) tid"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.concat(words_of(text), F.array(F.lit(""))).alias("w"))
    places = base.select("doc_id", "mark", F.posexplode("w").alias("pos", "term"))
    found = places.join(F.broadcast(table) if n <= BROADCAST_TERMS else table, "term").select("tid", "doc_id", "mark", "pos")
    return materialize(spark, found, "postings")


def _spread(index: DataFrame) -> DataFrame:
    """Occurrences of each term, over all documents."""
    return index.where("tid is not null").groupBy("tid").agg(F.count("*").alias("n"))


def phrase_matches(spark: SparkSession, index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, mark, item, low, high)``: ranges of document positions that windows of items cover.

    ``items`` has (item, tid, j, size).  An item of fewer words than a window is one window.
    """
    width = F.least(F.lit(window), F.col("size"))
    ranked = items.join(_spread(index), "tid")
    # each word is in the windows that start up to width - 1 words before it
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("j") - width + 1), F.least(F.col("j"), F.col("size") - width))).alias("start")
    windows = ranked.select("item", "tid", "j", "size", "n", start)
    rarest = windows.groupBy("item", "start", "size").agg(F.count("*").alias("found"), F.min(F.struct("n", "j", "tid")).alias("r")).where(F.col("found") == width)
    anchors = rarest.select("item", F.col("r.j").alias("j"), F.col("r.tid").alias("tid")).distinct()
    anchors = materialize(spark, anchors, "anchors")

    shift = index.join(anchors, "tid").select("doc_id", "mark", "item", (F.col("pos") - F.col("j")).alias("shift"), F.col("j").alias("anchor"))
    around = items.select("item", "tid", "j")
    near = anchors.select("item", F.col("j").alias("anchor")).join(around, "item").where(F.abs(F.col("j") - F.col("anchor")) < window)
    asked = shift.distinct().join(near, ["item", "anchor"]).select("doc_id", "mark", "item", "shift", "j", "tid", (F.col("shift") + F.col("j")).alias("pos")).where("pos >= 0").distinct()
    asked = materialize(spark, asked, "asked")
    # the join's keys are null-safe: a null doc_id is a document like any other
    a, b = index.where("tid is not null").alias("a"), asked.alias("b")
    same = (F.col("a.tid") == F.col("b.tid")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.mark") == F.col("b.mark")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    match = a.join(b, same).select("b.doc_id", "b.mark", "b.item", "b.shift", "b.j").distinct()
    by = ["doc_id", "mark", "item", "shift"]
    run = match.withColumn("run", F.col("j") - F.row_number().over(Window.partitionBy(*by).orderBy("j")))
    runs = run.groupBy(*by, "run").agg(F.min("j").alias("first"), F.count("*").alias("n"))
    sizes = items.select("item", "size").distinct()
    return runs.join(sizes, "item").where(F.col("n") >= width).select("doc_id", "mark", "item", (F.col("shift") + F.col("first")).alias("low"), (F.col("shift") + F.col("first") + F.col("n")).alias("high"))


def proximity_matches(spark: SparkSession, index: DataFrame, items: DataFrame, slop: int = WINDOW, terms: int = 3) -> DataFrame:
    """``(doc_id, mark, item, low, high)``: places where an item's ``terms`` rarest different terms
    stand within ``slop`` words of the rarest one, in any order.

    ``items`` has (item, tid, term, j, size).  Rarity is by occurrences in the corpus, ties by the term; an item
    with one of these terms nowhere in the corpus has no match.  Each document's postings of these few
    terms are sorted by position once; no pairs of postings are made.
    """
    spread = items.select("item", "tid", "term").distinct().join(_spread(index), "tid", "left")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "term"))
    chosen = spread.withColumn("rank", rank).where(F.col("rank") <= terms)
    need = chosen.groupBy("item").agg(F.count("*").alias("need"))
    chosen = materialize(spark, chosen.join(need, "item").select("item", "tid", "rank", "need"), "rarest-terms")
    seat = index.join(chosen, "tid")
    around = Window.partitionBy("doc_id", "mark", "item").orderBy("pos").rangeBetween(-slop, slop)
    near = [F.max(F.when(F.col("rank") == k, 1).otherwise(0)).over(around) for k in range(1, terms + 1)]
    place = seat.select("doc_id", "mark", "item", "rank", "need", sum(near, F.lit(0)).alias("n"), F.min("pos").over(around).alias("low"), (F.max("pos").over(around) + 1).alias("high"))
    return place.where("rank = 1 and n = need").select("doc_id", "mark", "item", "low", "high")


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, mark, n_words, n_hit, item_ids, longest, near_ids)``, one row for each row of ``docs``.

    ``n_hit`` counts a document's words inside any occurrence of a window; ``item_ids`` are the ids of
    the items with occurring windows, distinct and sorted as strings.  ``longest`` is the length in words
    of the longest phrase of an item; ``near_ids`` are the ids of items with proximity matches.

    Defined cases: a null or wordless text has no words; an item without words has no window; an
    item with a null id hits words but isn't listed; repeated items count once.  Repeated rows of
    ``docs`` get equal results, null doc_ids are documents like any other, extra columns are not
    read, and empty tables give no hits or no rows.
    """
    spoken = materialize(spark, item_words(items), "benchmark-words")
    item = spoken.withColumn("tid", F.xxhash64("term"))
    index = build_index(spark, docs, item.select("term", "tid").distinct())
    ranges = materialize(spark, phrase_matches(spark, index, item.select("item", "tid", "j", "size"), window), "phrase-matches")

    key = ["doc_id", "mark"]
    names = item.select("item", "item_id").distinct()
    near = proximity_matches(spark, index, item).select(*key, "item").distinct().join(names, "item").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("near_ids"))
    hit = ranges.select(*key, F.explode(F.sequence("low", F.col("high") - 1)).alias("pos")).groupBy(*key).agg(F.countDistinct("pos").alias("n_hit"))
    found = ranges.join(names, "item").groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("high") - F.col("low")).cast("int").alias("longest"))
    result = index.where("tid is null").select(*key, F.col("pos").cast("long").alias("n_words")).alias("d")
    for k, part in enumerate((hit, found, near)):
        own = f"p{k}"
        result = result.join(part.withColumnsRenamed({"doc_id": f"{own}_id", "mark": f"{own}_mark"}), (F.col("mark") == F.col(f"{own}_mark")) & F.col("doc_id").eqNullSafe(F.col(f"{own}_id")), "left")
    none = F.array().cast("array<string>")
    return result.select(
        *key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("near_ids", none).alias("near_ids"),
    )


def leaked(judged: DataFrame, window: int = WINDOW) -> DataFrame:
    """Keys ``(doc_id, mark)`` of documents that hold a whole window of ``window`` words, or of whose words a
    twentieth or more is inside windows (of shorter items)."""
    return judged.where((F.col("longest") >= window) | (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select("doc_id", "mark").distinct()


def without_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all their columns, that are not ``leaked``."""
    gone = materialize(spark, leaked(contamination(spark, docs, items, window), window), "leaks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("mark")).alias("d")
    same = F.col("d.row.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.mark") == F.col("g.mark"))
    return rows.join(gone.alias("g"), same, "left_anti").select("d.row.*")
