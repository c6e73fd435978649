"""Removal of passages that repeat earlier documents, by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller
id.  In a suffix array, the longest match of a suffix with any earlier document is with the
nearest suffix before it, or after it, that belongs to an earlier document: the previous and next
smaller values.  So two neighbours and their common prefixes give the longest previous factor.

No machine holds the suffix array of a corpus.  Every string of ``length`` bytes selects the
``GRAM``-byte gram in it with the smallest hash, and equal strings select equal grams; all
strings that select one occurrence of a gram make one slice of the text (``length`` + a few
bytes).  Only slices of equal grams can hold equal strings, so:

1. of a string of ``length`` bytes around a gram, half of what is beside the gram lies on one side:
   slices whose gram, with so many bytes to its left or to its right, is in more than one document are
   found from hashes alone;
2. runs of such slices are cut from the texts, in blocks that end where a gram's hash says so, the
   same way in every copy; equal blocks collapse to their first document;
3. blocks that are left are cut into slices, and equal slices collapse to their first document;
4. slices are dealt by gram to buckets of bounded size, and each bucket gets its arrays;
5. the covered ranges go back to blocks and documents.

A gram with very many different slices is split: its strings become slices of their own, dealt
by their content.  Documents that equal an earlier one as a whole skip steps 2 to 4.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import discard, join_by_weight, materialize
from .textkit import Rolling, chunks, mix, ragged, span_hashes, utf8

LENGTH, GRAM = 50, 16
#: Corpus bytes for each bucket of codes; bytes of slices for each bucket of suffixes.
BUCKET_BYTES, SUFFIX_BYTES = 16 << 20, 1 << 20
#: Different slices of one gram in one bucket; a gram with more is split.
MOST_SLICES = 8192
#: Bytes of text that are scanned for codes at a time: a code goes to its bucket once for each.
SCANNED = 1 << 20
#: Up to so many split grams are broadcast; more are joined by shuffle.
BROADCAST_GRAMS = 1_000_000
#: One in so many grams ends a block.
BLOCK = 8
_PIECE, _PLACE_BITS = 1 << 23, 24


def slices(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, hashed: Rolling | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, gram places, starts and ends of all slices of the texts in a buffer, by place.

    The strings of ``length`` bytes of all texts are each in exactly one slice.  ``hashed`` may hold
    the buffer's hashes.
    """
    found = []
    for low in range(0, max(1, len(data)), _PIECE):  # only a very long text has a second piece
        part = data[low : low + _PIECE + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            continue
        rolling = hashed if hashed is not None and len(part) == len(data) else Rolling(part)
        at = np.arange(len(part) - gram + 1)
        hashes = mix(rolling.spans(at, at + gram))
        least = (hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | at.astype(np.uint64)
        width, span = length - gram + 1, 1
        while 2 * span <= width:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if width > span:
            least = np.minimum(least[: span - width], least[width - span :])
        chosen = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)  # the leftmost among equals
        inside = np.zeros(len(part) + 1, np.int64)
        first, last = offsets[:-1] - low, offsets[1:] - low - length + 1
        full = last > first
        np.add.at(inside, np.clip(first[full], 0, len(part)), 1)
        np.add.at(inside, np.clip(last[full], 0, len(part)), -1)
        window = np.flatnonzero(np.cumsum(inside)[:n] > 0)
        if len(window):
            own = chosen[window]
            new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (window[1:] != window[:-1] + 1))))
            stop = np.append(new[1:], len(window)) - 1
            found.append((hashes[own[new]], own[new] + low, window[new] + low, window[stop] + length + low))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def _codes(rolling: Rolling, offsets: np.ndarray, grams: np.ndarray, row: np.ndarray, buckets: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each gram, bucket and 32 more bits of the hashes of it and half of the rest of a string to its
    left, and to its right; 0 where the text ends before."""
    half = (length - gram) // 2
    out = []
    for side, (low, high) in enumerate(((grams - half, grams + gram), (grams, grams + gram + half))):
        inside = (low >= offsets[row]) & (high <= offsets[row + 1])
        hashes = mix(rolling.spans(np.where(inside, low, 0), np.where(inside, high, 0)) + np.uint64(side))
        out.append(np.where(inside, ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF)) | np.uint64(1), 0))
    return tuple(out)


def _small_sort(x: np.ndarray) -> np.ndarray:
    """Stable order of small numbers: 16 bits are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def _entries(buckets: int, length: int, gram: int):
    """Rows by bucket: documents, their numbers of codes, and the codes.

    Of a chunk, a code's bucket gets only its first document.  The chunk's other documents with
    this code know already that it repeats; that goes to buckets dealt by document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for low, high, data, at in chunks(batch.column("text"), SCANNED):
                raw = data.tobytes()
                marks = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint32)
                rolling = Rolling(data)
                _, grams, starts, _ = slices(data, at, length, gram, rolling)
                row = np.searchsorted(at, starts, "right") - 1
                code = np.concatenate(_codes(rolling, at, grams, row, buckets, length, gram))
                row = np.concatenate((row, row))[code > 0]
                code = code[code > 0]
                # rows by id, then stably by code
                place = np.empty(high - low, np.int64)
                place[np.argsort(ids[low:high], kind="stable")] = np.arange(high - low)
                order = _small_sort(place[row])
                order = order[np.argsort(code[order], kind="stable")]
                code, row = code[order], row[order]
                fresh = np.concatenate(([True], code[1:] != code[:-1]))[: len(code)]
                same = np.concatenate(([False], (code[1:] == code[:-1]) & (row[1:] == row[:-1])))[: len(code)]
                code, row, fresh = code[~same], row[~same], fresh[~same]
                group = np.cumsum(fresh) - 1
                shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else fresh
                out: list[tuple] = []

                def put(kind: int, where: np.ndarray, chosen: np.ndarray) -> None:
                    by = _small_sort(row[chosen])
                    by = by[_small_sort(where[by])]
                    where, own, codes = where[by], row[chosen][by], code[chosen][by]
                    for k in np.split(np.arange(len(by)), np.flatnonzero(where[1:] != where[:-1]) + 1):
                        if len(k):
                            docs, n = np.unique(own[k], return_counts=True)
                            held = codes[k] if kind else (codes[k] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                            out.append((int(where[k[0]]), kind, ids[low + docs].astype(np.int64).tobytes(), marks[docs].tobytes(), n.astype(np.uint32).tobytes(), held.tobytes()))

                put(0, (code >> np.uint64(32))[fresh].astype(np.int64), np.flatnonzero(fresh))
                local = np.flatnonzero(shared)
                put(1, ((ids[low + row[local]].astype(np.int64) * 0x9E3779B1) >> 16) % buckets, local)
                for k in range(0, len(out), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[k : k + 512]), _ENTRY_TYPES)], _ENTRY)

    return run


_ENTRY = ["bucket", "kind", "docs", "marks", "n", "codes"]
_ENTRY_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _numbers(column, kind) -> np.ndarray:
    return np.frombuffer(utf8(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)[0].tobytes(), kind)


def _repeated(buckets: int):
    """Of a bucket: codes that also are in another document, packed by where their documents are dealt."""

    def run(table: pa.Table) -> pa.Table:
        docs, marks, codes = [], [], []
        for kind in (0, 1):
            own = table.filter(pa.array(table.column("kind").to_numpy() == kind))
            if own.num_rows:
                n = _numbers(own.column("n"), np.uint32)
                doc, mark = np.repeat(_numbers(own.column("docs"), np.int64), n), np.repeat(_numbers(own.column("marks"), np.uint32), n)
                code = _numbers(own.column("codes"), np.uint64 if kind else np.uint32).astype(np.uint64)
                if not kind:
                    code |= np.uint64(own.column("bucket")[0].as_py()) << np.uint64(32)
                    order = np.argsort(code, kind="stable")
                    doc, mark, code = doc[order], mark[order], code[order]
                    new = np.concatenate(([True], code[1:] != code[:-1]))
                    group = np.cumsum(new) - 1
                    begin = np.flatnonzero(new)
                    mixed = (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin))[group]
                    doc, mark, code = doc[mixed], mark[mixed], code[mixed]
                docs.append(doc)
                marks.append(mark)
                codes.append(code)
        doc, mark, code = np.concatenate(docs), np.concatenate(marks), np.concatenate(codes)
        deal = (mix(doc.astype(np.uint64) ^ mark.astype(np.uint64) << np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((mark, doc, deal))
        doc, mark, code, deal = doc[order], mark[order], code[order], deal[order]
        begin = _runs(doc, mark)
        n = np.diff(np.append(begin, len(doc))).astype(np.uint32)
        doc, mark, own = doc[begin], mark[begin], deal[begin]
        first = _runs(own)
        at, code_at = np.append(first, len(own)).tolist(), np.append(begin[first], len(code)).tolist()
        packs = {
            name: pa.array([values[low:high].tobytes() for low, high in zip(edges[:-1], edges[1:])], pa.binary())
            for name, values, edges in (("docs", doc, at), ("marks", mark, at), ("n", n, at), ("codes", code, code_at))
        }
        return pa.table({"deal": pa.array(own[first])} | packs)

    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _gathered(table: pa.Table) -> pa.Table:
    """Of the documents dealt to one place: for each all its codes, of all buckets."""
    doc, mark = _numbers(table.column("docs"), np.int64), _numbers(table.column("marks"), np.uint32)
    n, code = _numbers(table.column("n"), np.uint32).astype(np.int64), _numbers(table.column("codes"), np.uint64)
    start, order = np.cumsum(n) - n, np.lexsort((mark, doc))
    doc, mark, n = doc[order], mark[order], n[order]
    raw, begin = code[ragged(start[order], n)].tobytes(), _runs(doc, mark)
    edges = (8 * np.append(np.cumsum(n) - n, n.sum())[np.append(begin, len(n))]).tolist()
    cut = [raw[low:high] for low, high in zip(edges[:-1], edges[1:])]
    return pa.table({"doc_id": pa.array(doc[begin]), "mark": pa.array(mark[begin].astype(np.int64)), "codes": pa.array(cut, pa.binary())})


def _cut(buckets: int, length: int, gram: int):
    """Blocks: runs of adjacent slices with a listed code of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("codes")
            for low, high, data, at in chunks(batch.column("text")):
                rolling = Rolling(data)
                hashes, grams, starts, ends = slices(data, at, length, gram, rolling)
                row = np.searchsorted(at, starts, "right") - 1
                left, right = _codes(rolling, at, grams, row, buckets, length, gram)
                # a code that is in two documents is listed with each document that has it
                listed = np.unique(_numbers(wanted.slice(low, high - low), np.uint64))
                chosen = np.flatnonzero(np.isin(left, listed) | np.isin(right, listed))
                row = row[chosen]
                last = mix(hashes[chosen]) % np.uint64(BLOCK) == 0
                new = np.concatenate(([True], last[:-1] | (chosen[1:] != chosen[:-1] + 1) | (row[1:] != row[:-1])))[: len(chosen)]
                first = np.flatnonzero(new)
                begin, end = starts[chosen[first]], ends[chosen[(np.append(first[1:], len(chosen)) - 1)[: len(first)]]]
                key, row, lead = span_hashes(data, begin, end), row[first], hashes[chosen[first]]
                raw = data.tobytes()
                for k in range(0, len(first), 20_000):
                    part = slice(k, k + 20_000)
                    index = pa.array(low + row[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(index),
                            batch.column("mark").take(index),
                            pa.array(begin[part] - at[row[part]]),
                            pa.array(lead[part].view(np.int64)),
                            pa.array(key[part].view(np.int64)),
                            pa.array([raw[a:b] for a, b in zip(begin[part].tolist(), end[part].tolist())], pa.binary()),
                        ],
                        ["doc_id", "mark", "at", "lead", "block_key", "block"],
                    )

    return run


def _recut(length: int, gram: int):
    """The slices of distinct blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, data, at in chunks(batch.column("block")):
                rolling = Rolling(data)
                hashes, _, starts, ends = slices(data, at, length, gram, rolling)
                row, raw = np.searchsorted(at, starts, "right") - 1, data.tobytes()
                key = span_hashes(data, starts, ends)
                for k in range(0, len(starts), 50_000):
                    part = slice(k, k + 50_000)
                    index = pa.array(low + row[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c).take(index) for c in ("lead", "block_key", "first_doc")),
                            pa.array((starts[part] - at[row[part]]).astype(np.int32)),
                            pa.array(hashes[part].view(np.int64)),
                            pa.array(key[part].view(np.int64)),
                            pa.array([raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())], pa.binary()),
                        ],
                        ["lead", "block_key", "first_doc", "at", "gram", "slice_key", "slice"],
                    )

    return run


#: Suffixes are told apart by so many bytes: matches are no longer than that.
DEPTH = 56
_SYMBOLS, _BITS = 7, 9  # in one 64-bit word; a byte is 1 to 256, a string's end 0


def suffix_words(data: np.ndarray, places: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The first ``DEPTH`` symbols of the suffixes at ``places``, seven to a word, a row of words for
    each seven; ``rest`` tells how many bytes a suffix has."""
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(DEPTH + _SYMBOLS, np.uint64)))
    word = np.zeros(len(data) + DEPTH, np.uint64)
    for k in range(_SYMBOLS):
        word = word << np.uint64(_BITS) | padded[k : k + len(word)]
    out = np.empty((DEPTH // _SYMBOLS, len(places)), np.uint64)
    for k in range(len(out)):
        beyond = (np.clip(_SYMBOLS * (k + 1) - rest, 0, _SYMBOLS) * _BITS).astype(np.uint64)
        out[k] = word[places + _SYMBOLS * k] >> beyond << beyond
    return out


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length in bytes, up to ``DEPTH``, of what columns ``a`` and ``b`` of ``words`` share."""
    total, going = np.zeros(len(a), np.int64), np.arange(len(a))
    for row in words:
        differ = row[a[going]] ^ row[b[going]]
        for k in range(_SYMBOLS):
            total[going] += differ >> np.uint64(_BITS * (_SYMBOLS - 1 - k)) == 0
        going = going[differ == 0]
    return total


def _previous_smaller(value: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left, or -1, for all places at once.

    A place that isn't smaller hands on its own candidate: between that and the place there is
    nothing smaller than the place.
    """
    n = len(value)
    at = np.arange(n + 1) - 1  # shifted by one: index 0 is a value below all
    at[0] = 0
    full = np.concatenate(([np.iinfo(np.int64).min], value))
    active = np.arange(1, n + 1)
    while len(active):
        active = active[full[at[active]] >= full[active]]
        at[active] = at[at[active]]
    return at[1:] - 1


def longest_previous_factors(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``least`` bytes or more to their string's end, and for each the longest match, up
    to ``DEPTH``, with a place in a string of a smaller owner.

    ``data`` holds strings at ``offsets``, ``owner`` an integer for each.  Matches never cross
    strings.  In the sorted suffixes, the best match with smaller owners is the nearest of them
    before or after a suffix.
    """
    size = np.diff(offsets)
    number = np.maximum(size - least + 1, 0)
    places = ragged(offsets[:-1], number)
    if not len(places):
        return places, places
    rest = np.repeat(offsets[1:], number) - places
    words = suffix_words(data, places, rest)
    # big-endian words compare like their bytes; how equal suffixes are ordered makes no difference
    order = np.argsort(np.ascontiguousarray(words.T, ">u8").view(f"S{8 * len(words)}").ravel())
    words, rest = words[:, order], rest[order]
    value = np.repeat(owner, number)[order]
    best = np.zeros(len(places), np.int64)
    for near in (_previous_smaller(value), len(value) - 1 - _previous_smaller(value[::-1])[::-1]):
        has = np.flatnonzero((near >= 0) & (near < len(value)))
        match = common_prefixes(words, has, near[has])
        best[has] = np.maximum(best[has], np.minimum(match, np.minimum(rest[has], rest[near[has]])))
    out = np.empty(len(places), np.int64)
    out[order] = best
    return places, out


_PLACE = ["gram", "slice_key", "holders", "lead", "block_key", "at"]


def _covered(length: int):
    """Ranges of a bucket's slices that also are in slices of earlier documents."""

    def run(table: pa.Table) -> pa.Table:
        # a gram's only slice has nothing to match
        gram = table.column("gram").to_numpy()
        _, which, n = np.unique(gram, return_inverse=True, return_counts=True)
        table = table.filter(pa.array(n[which] > 1))
        data, at = utf8(table.column("slice").combine_chunks())
        owner, shift = table.column("owner").to_numpy(), table.column("shift").to_numpy()
        places, match = longest_previous_factors(data, at, owner, length)
        hit = places[match >= length]
        row = np.searchsorted(at, hit, "right") - 1
        # runs of starts make one range
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (hit[1:] != hit[:-1] + 1)))[: len(hit)])
        last = (np.append(new[1:], len(hit)) - 1)[: len(new)]
        row, index = row[new], pa.array(row[new])
        begin = at[:-1][row] - shift[row]
        return pa.table(
            {
                **{c: table.column(c).take(index) for c in _PLACE},
                "low": pa.array((hit[new] - begin).astype(np.int32)),
                "high": pa.array((hit[last] + length - begin).astype(np.int32)),
            }
        )

    return run


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, ranges = batch.column("whole").to_pylist(), batch.column("ranges")
        for low, high, data, at in chunks(batch.column("text")):
            raw, out = data.tobytes(), []
            for k in range(low, high):
                text = raw[at[k - low] : at[k - low + 1]]
                kept, gone, spans = text, 0, 0
                if whole[k]:
                    kept, gone, spans = b"", len(text), 1
                elif ranges[k].is_valid:
                    marks = np.zeros(len(text) + 1, np.int64)
                    own = ranges[k].values
                    np.add.at(marks, own.field("low").to_numpy(), 1)
                    np.add.at(marks, own.field("high").to_numpy(), -1)
                    dead = np.cumsum(marks)[:-1] > 0
                    gone = int(dead.sum())
                    spans = int((dead & ~np.concatenate(([False], dead[:-1]))).sum())
                    kept = np.frombuffer(text, np.uint8)[~dead].tobytes()
                out.append((len(text), gone, spans, kept))
            n, gone, spans, kept = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def remove_repeats(spark: SparkSession, docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``, one row for each row of ``docs``.

    ``kept`` holds the bytes of the text (UTF-8) without those covered by a string of ``length``
    bytes that also starts in a document with a smaller doc_id; what counts is the input, not
    what is left.  ``length`` is 16 to 56 (``GRAM`` to ``DEPTH``).

    Defined cases: a null text is empty; a text under ``length`` bytes keeps everything.
    Rows with one doc_id are no reason to remove anything from each other; repeated rows get
    equal results.  A row with a null doc_id has no place in the order: it keeps everything and
    removes nothing elsewhere.  Other columns are not read.  An empty table gives an empty result.
    """
    if not gram <= length <= DEPTH:
        raise ValueError(f"length must be from {gram} to {DEPTH}")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = every.where("doc_id is not null")
    total = base.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    entries = base.mapInArrow(_entries(buckets, length, gram), "bucket int, kind int, docs binary, marks binary, n binary, codes binary")
    repeated = entries.groupBy("bucket").applyInArrow(_repeated(buckets), "deal long, docs binary, marks binary, n binary, codes binary")
    repeated = materialize(spark, repeated, "repeats-grams")

    marked = base.select("doc_id", F.crc32("text").alias("mark"), F.unhex(F.sha2("text", 256)).alias("sha"))
    marked = materialize(spark, marked.where(F.octet_length("text") >= length), "repeats-marked")
    first = marked.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")
    first = materialize(spark, first, "repeats-first")
    copies = join_by_weight(spark, marked, first, "sha", "copies").where("doc_id > first_doc").select("doc_id", "mark").distinct()
    copies = materialize(spark, copies, "repeats-copies")
    discard(spark, marked, first)

    keyed = base.withColumn("mark", F.crc32("text"))
    listed = repeated.groupBy("deal").applyInArrow(_gathered, "doc_id long, mark long, codes binary")
    wanted = listed.join(copies, ["doc_id", "mark"], "left_anti")
    cut = keyed.join(wanted, ["doc_id", "mark"]).select("doc_id", "mark", "text", "codes").mapInArrow(_cut(buckets, length, gram), "doc_id long, mark long, at long, lead long, block_key long, block binary")
    found = materialize(spark, cut, "repeats-found")
    discard(spark, repeated)
    block = ["lead", "block_key"]
    blocks = materialize(spark, found.groupBy(*block).agg(F.min("doc_id").alias("first_doc"), F.first("block").alias("block")), "repeats-blocks")

    one = ["gram", "slice_key"]
    parted = blocks.mapInArrow(_recut(length, gram), "lead long, block_key long, first_doc long, at int, gram long, slice_key long, slice binary")
    place = F.min(F.struct(F.col("first_doc").alias("owner"), *block, "at")).alias("place")
    distinct = parted.groupBy(*one).agg(place, F.count("*").alias("holders"), F.first("slice").alias("slice"))
    distinct = materialize(spark, distinct.select(*one, "place.*", "holders", "slice"), "repeats-slices")
    size = distinct.agg(F.sum(F.octet_length("slice")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // SUFFIX_BYTES))
    crowded = distinct.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SLICES).select("gram")
    n_crowded = crowded.count()  # most often none: nothing is written then
    dealt = distinct.select(*_PLACE, "owner", "slice", F.lit(0).alias("shift"), F.pmod("gram", F.lit(parts)).cast("int").alias("part"))
    if n_crowded:
        crowded = materialize(spark, crowded, "repeats-crowded")
        few = F.broadcast(crowded) if n_crowded <= BROADCAST_GRAMS else crowded
        windows = distinct.join(few, "gram", "left_semi").select(*_PLACE, "owner", "slice", F.explode(F.sequence(F.lit(0), F.octet_length("slice") - length)).alias("shift"))
        windows = windows.withColumn("slice", F.substring("slice", F.col("shift") + 1, F.lit(length))).withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(parts)).cast("int"))
        dealt = dealt.join(few, "gram", "left_anti").unionByName(windows)
    covered = dealt.groupBy("part").applyInArrow(_covered(length), "gram long, slice_key long, holders long, lead long, block_key long, at int, low int, high int")
    covered = materialize(spark, covered, "repeats-covered")

    def shifted() -> list:
        return [(F.col("at") + F.col("low")).cast("long").alias("low"), (F.col("at") + F.col("high")).cast("long").alias("high")]

    # a slice in one block only: its ranges are the block's; else each block that holds it gets them
    # or, if its first document comes after the slice's, all of it
    inner = covered.where("holders > 1").groupBy(*one).agg(F.collect_set(F.struct("low", "high")).alias("inner"))
    # written, so that both sides of the next join come from a shuffle: only such joins are split where a slice is in very many blocks
    owners = materialize(spark, distinct.where("holders > 1").select(*one, "owner").join(inner, one, "left"), "repeats-owners")
    held = parted.select(*one, *block, "first_doc", "at", F.octet_length("slice").alias("size")).join(owners, one)
    entire = F.array(F.struct(F.lit(0).alias("low"), F.col("size").alias("high")))
    gone = F.when(F.col("first_doc") > F.col("owner"), entire).otherwise(F.col("inner"))
    several = held.select(*block, "at", F.explode(gone).alias("r")).select(*block, "at", "r.low", "r.high")
    single = covered.where("holders = 1").select(*block, "at", "low", "high")
    in_blocks = single.unionByName(several).groupBy(*block).agg(F.collect_set(F.struct(*shifted())).alias("own"))
    judged = materialize(spark, blocks.select(*block, "first_doc", F.octet_length("block").cast("long").alias("size")).join(in_blocks, block, "left"), "repeats-judged")
    discard(spark, blocks, distinct, covered, owners, *([crowded] if n_crowded else []))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("size").alias("high")))
    hit = found.drop("block").join(judged, block).withColumn("own", F.when(F.col("doc_id") > F.col("first_doc"), whole).otherwise(F.col("own"))).where("own is not null")
    hit = hit.select("doc_id", "mark", "at", F.explode("own").alias("r")).select("doc_id", "mark", "at", "r.low", "r.high")
    ranges = hit.select("doc_id", "mark", F.struct(*shifted()).alias("r")).groupBy("doc_id", "mark").agg(F.collect_set("r").alias("ranges"), F.lit(False).alias("whole"))
    plan = ranges.unionByName(copies.select("doc_id", "mark", F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("ranges"), F.lit(True).alias("whole")))
    plan = materialize(spark, plan, "repeats-ranges")
    discard(spark, found, judged, copies)
    # rows without doc_id match nothing and pass
    judged = every.withColumn("mark", F.crc32("text")).join(plan, ["doc_id", "mark"], "left").select("doc_id", "text", "ranges", F.coalesce("whole", F.lit(False)).alias("whole"))
    return judged.mapInArrow(_pruned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
