"""Near-duplicate documents: one-permutation MinHash with optimal densification.

A text's shingle hashes are dealt to ``BINS`` bins by their top bits and each bin keeps its
smallest hash: one hash per shingle instead of one per shingle and permutation.  An empty bin
takes the value of another bin, which a hash of the bin and the attempt picks, the same for
every text ("optimal densification"), so that bins stay independent even for tiny sets.
``ROWS`` bins make a band, a band's values make a bucket.

Plan: texts with equal sets collapse to one representative first.  In each bucket every member
is paired with one centre only (a star: n - 1 candidate edges, not n^2), and the edges are
confirmed on full sets.  The centre is the member that shares most buckets with others: of a group
of edited copies that is the least edited one, to which nearly all others are linked.

A star alone could miss links between two members that are both unlike its centre.  So buckets
whose members are still in several components get a second round: members outside the bucket's
main component are matched with those of other components by parities.  Each shingle flips one of
``PARITY`` bits, so that two sets differ by at least the bits that do: the comparison, of machine words
inside the join, rules out most pairs and never a link.  The rest is confirmed on full sets.
Such a pair is matched in the first of the buckets that it shares.  Each pair that shares a bucket
is thus confirmed, refuted or already connected.

A bucket may hold a third of all sets.  Its rows meet what belongs to their bucket by a broadcast of
the heaviest buckets, at most ``staging.HEAVY`` of them, and by a shuffle for the others.  A set with
many candidate edges is copied once for every ``staging.HOT`` of them, and the second round's comparison of a
bucket is cut into cells of at most about ``CELL`` by ``CELL`` members, each a key of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .staging import HOT, discard, hot_keys, join_by_weight, materialize
from .textkit import LOWER, chunks, mix, set_of, span_hashes, words

BINS, ROWS = 128, 4
#: Attempts at densifying before an empty bin takes the next filled one.
ATTEMPTS = 64
#: Bits of the second round's parities.
PARITY = 1024
_PLANES = PARITY // 64
#: Members on a side of one cell of the second round.
CELL = 512
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = ~set_of("\x20\x09\x0a\x0b\x0c\x0d")


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its ``n``-word shingles.

    Words are runs without white space, A-Z lower-cased.  A text of fewer words has one
    shingle, all its words; one without words, or null, has none.
    """
    weight = mix(np.arange(1, n + 2, dtype=np.uint64)) | np.uint64(1)
    for _, _, data, offsets in chunks(column):
        low = LOWER[data]
        starts, ends, bounds = words(low, offsets, _WORD)
        each = span_hashes(low, starts, ends)
        full = np.zeros(max(0, len(each) - n + 1), np.uint64)
        for k in range(n if len(full) else 0):
            full += each[k : k + len(full)] * weight[k]
        full = mix(full)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= n:
                one = np.sort(full[a : b - n + 1])
                yield one[np.concatenate(([True], one[1:] != one[:-1]))]
            elif b > a:
                yield mix((each[a:b] * weight[: b - a]).sum(keepdims=True) + weight[n : n + 1] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def densified(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` MinHash values for each set; rows of empty sets mean nothing."""
    bits = np.uint64(64 - (bins.bit_length() - 1))
    edges = np.arange(bins, dtype=np.uint64) << bits
    out = np.full((len(sets), bins), _EMPTY)
    filled = np.zeros((len(sets), bins), bool)
    for k, one in enumerate(sets):
        if len(one):
            at = np.append(np.searchsorted(one, edges), len(one))
            filled[k] = at[1:] > at[:-1]
            out[k, filled[k]] = one[at[:-1][filled[k]]]
    has = filled.any(axis=1)
    row, column = np.nonzero(~filled & has[:, None])
    for attempt in range(ATTEMPTS):
        if not len(row):
            break
        pick = (mix(column.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = filled[row, pick]
        out[row[hit], column[hit]] = out[row[hit], pick[hit]]
        row, column = row[~hit], column[~hit]
    for r, c in zip(row.tolist(), column.tolist()):
        full = np.flatnonzero(filled[r])
        out[r, c] = out[r, full[np.searchsorted(full, c) % len(full)]]
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key for each band of ``rows`` values; the band is part of the key."""
    bands = values.shape[1] // rows
    keys = np.repeat(mix(np.arange(bands, dtype=np.uint64))[None, :], len(values), 0)
    for k in range(rows):
        keys = mix(keys ^ values[:, k :: rows][:, :bands])
    return keys


def _signatures(n: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group: list[np.ndarray] = []
            size, ones, twos, keys = [], [], [], []

            def flush() -> None:
                if group:
                    keys.append(band_keys(densified(group, bins), rows))
                    group.clear()

            for one in shingle_sets(batch.column("text"), n):
                size.append(len(one))
                ones.append(int(one.sum(dtype=np.uint64)))
                twos.append(int(np.bitwise_xor.reduce(mix(one))) if len(one) else 0)
                group.append(one)
                if len(group) >= 1024 or sum(size[-len(group) :]) > 1 << 20:
                    flush()
            flush()
            flat = np.concatenate(keys) if keys else np.zeros((0, bins // rows), np.uint64)
            at = np.arange(len(size) + 1, dtype=np.int32) * np.int32(bins // rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("mark"),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(ones, np.uint64).view(np.int64)),
                    pa.array(np.array(twos, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat.reshape(-1).view(np.int64))),
                ],
                ["doc_id", "mark", "n_shingles", "d1", "d2", "bands"],
            )

    return run


def parity_words(one: np.ndarray) -> np.ndarray:
    """``_PLANES`` 64-bit words; each hash flips the bit that its top bits pick."""
    at = (one >> np.uint64(64 - (PARITY.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(np.uint8)).view(np.int64)


def _blobs(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, at = [], 0, 0
            for k, one in enumerate(shingle_sets(batch.column("text"), n), 1):
                held.append(one)
                size += one.nbytes
                if size > 16 << 20 or len(held) == 1024 or k == batch.num_rows:
                    edges = pa.array(np.arange(len(held) + 1, dtype=np.int32) * np.int32(_PLANES))
                    parity = pa.ListArray.from_arrays(edges, pa.array(np.concatenate([parity_words(x) for x in held])))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, k - at), pa.array([x.tobytes() for x in held], pa.binary()), parity], ["doc_id", "shingles", "parity"])
                    held, size, at = [], 0, k

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate((p, q)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(
    spark: SparkSession, docs: DataFrame, *, words_per_shingle: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, mark)``, one row for each row of ``docs``.

    Two documents are linked if ``100 * |intersection| >= percent * |union|`` of their shingle
    sets; ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks the
    documents that are their component's smallest.  ``mark`` (xxhash64 of the text) tells rows of one
    doc_id apart.

    Defined cases: a null or wordless text has an empty set, is linked with nothing and kept.
    A text with fewer words than a shingle is one shingle.  Repeated rows give repeated results;
    rows that share a doc_id but not a text are judged each by its text.  A null doc_id is
    never linked: component_id is null and the row is kept.  Ties can't change a result.  Columns
    other than doc_id and text are not read.  An empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark"))
    signed = materialize(
        spark,
        base.mapInArrow(_signatures(words_per_shingle, bins, rows), "doc_id long, mark long, n_shingles long, d1 long, d2 long, bands array<long>"),
        "minhash-signed",
    )
    alike = ["n_shingles", "d1", "d2"]
    distinct = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*alike).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    distinct = materialize(spark, distinct, "minhash-distinct")
    member = distinct.select("rep", "n_shingles", F.posexplode("bands").alias("band", "key"))
    full = materialize(spark, member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "minhash-full")
    shared = materialize(spark, join_by_weight(spark, member, full, "key", "n"), "minhash-shared")
    # how many others a set meets in all its buckets; the set that meets most is a bucket's centre
    weight = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    ids = materialize(spark, weight, "minhash-ids")
    ranked = shared.join(ids, "rep")
    centre = ranked.groupBy("key").agg(F.max(F.struct("weight", F.bitwise_not("rep").alias("least"), "n_shingles")).alias("c"), F.count("*").alias("rows"))
    centre = materialize(spark, centre.select("key", F.bitwise_not("c.least").alias("centre"), F.col("c.n_shingles").alias("centre_size"), "rows"), "minhash-centre")
    seats = materialize(spark, join_by_weight(spark, shared, centre, "key", "rows").drop("rows"), "minhash-seats")
    discard(spark, shared, full, centre)

    wanted = base.drop("mark").join(ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = materialize(spark, wanted.mapInArrow(_blobs(words_per_shingle), "doc_id long, shingles binary, parity array<long>"), "minhash-sets")
    def possible(a: str, b: str):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def confirm(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs``, a materialized table."""
        found = pairs
        for end, other, name in (("b", "a", "y"), ("a", "b", "x")):
            parts = F.broadcast(hot_keys(pairs, end).select(end, F.ceil(F.col("n") / HOT).alias("parts")))
            whole = F.coalesce("parts", F.lit(1))
            dealt = found.join(parts, end, "left").withColumn("part", F.pmod(F.xxhash64(other), whole)).drop("parts")
            held = sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(name)).join(parts, end, "left")
            held = held.select(end, name, F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("part"))
            found = dealt.join(held, [end, "part"]).drop("part")
        return found.select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a long, b long")

    star = seats.where(F.col("rep") != F.col("centre")).where(possible("n_shingles", "centre_size")).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    star = materialize(spark, star, "minhash-star")
    links = materialize(spark, confirm(star), "minhash-links")
    found = connected_components(spark, links, "a", "b", "minhash-cc")

    # Second round: members of one bucket that neither the star nor other buckets connected.
    label = found.select(F.col("node").alias("rep"), "component")
    placed = seats.where("n > 2").join(label, "rep", "left").select("key", "band", "rep", "centre", "n_shingles", F.coalesce("component", "rep").alias("component"))
    placed = materialize(spark, placed, "minhash-placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
    mixed = parts.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("rows"), F.max("n").alias("most"), F.count("*").alias("parts"))
    mixed = materialize(spark, mixed.where("parts > 1").select("key", "main", "rows", "most"), "minhash-mixed")
    open_seats = join_by_weight(spark, placed.where("rep <> centre"), mixed, "key", "rows")
    # a bucket's grid: so many rows of cells for the members outside the main component, so many columns for all
    open_seats = open_seats.withColumn("down", F.ceil((F.col("rows") - F.col("most")) / CELL)).withColumn("across", F.ceil(F.col("rows") / CELL))
    parity = sets.select(F.col("doc_id").alias("rep"), "parity")
    whole = distinct.select("rep", "bands")
    open_seats = open_seats.join(whole, "rep").where(F.array_contains("bands", F.col("key"))).withColumn("before", F.slice("bands", F.lit(1), F.col("band")))
    planes = [F.get("parity", F.lit(k)).alias(f"t{k}") for k in range(_PLANES)]
    open_seats = open_seats.join(parity, "rep").select("key", "before", "main", "rep", "n_shingles", "component", "down", "across", *planes)
    own, zero = F.xxhash64("rep"), F.lit(0).cast("long")
    p = open_seats.where("component <> main").withColumn("row", F.pmod(own, "down")).withColumn("column", F.explode(F.sequence(zero, F.col("across") - 1))).alias("p")
    q = open_seats.withColumn("column", F.pmod(own, "across")).withColumn("row", F.explode(F.sequence(zero, F.col("down") - 1))).alias("q")
    differ = sum((F.bit_count(F.col(f"p.t{k}").bitwiseXOR(F.col(f"q.t{k}"))) for k in range(_PLANES)), F.lit(0))
    # |a & b| and |a | b| are half of |a| + |b| less and plus the difference
    near = (100 + percent) * differ <= (100 - percent) * (F.col("p.n_shingles") + F.col("q.n_shingles"))
    rest = p.join(
        q,
        (F.col("p.key") == F.col("q.key"))
        & (F.col("p.row") == F.col("q.row"))
        & (F.col("p.column") == F.col("q.column"))
        & (F.col("p.component") != F.col("q.component"))
        & ((F.col("q.component") == F.col("q.main")) | (F.col("p.rep") < F.col("q.rep")))
        & possible("p.n_shingles", "q.n_shingles")
        & near
        & ~F.arrays_overlap("p.before", "q.before"),
    ).select(F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b"))
    rest = materialize(spark, rest.distinct(), "minhash-rest")
    discard(spark, seats, placed, mixed)
    if rest.head(1):
        more = materialize(spark, confirm(rest), "minhash-more")
        if more.head(1):
            again = more.unionByName(found.select(F.col("component").alias("a"), F.col("node").alias("b")))
            found = connected_components(spark, again, "a", "b", "minhash-cc2")
    discard(spark, sets, star, links, rest, ids)

    component = distinct.select(*alike, "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*alike, F.coalesce("component", "rep").alias("component"))
    result = signed.select("doc_id", "mark", *alike).join(component, alike, "left")
    result = result.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "mark")
