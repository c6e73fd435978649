"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

The pre-tokeniser's pattern is run as a small automaton, without a regex engine.  Each code
point has a class, each class (with the apostrophe's look-ahead) is a function from state to
state, and functions compose associatively: every block of a text is folded to one function,
the blocks' functions are scanned, and a second pass within blocks gives the state before each
code point, and so where tokens start.  Equal slices are merged once per batch, by a cache.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textkit import chunks, distinct_spans, ragged, trimmed

#: Largest rank file that is shipped to executors.
MAX_RANK_BYTES = 64 << 20
CACHE, LONGEST_CACHED = 1 << 17, 64
_BLOCK = 256

# Code point classes; a symbol is a class, or an apostrophe with one or two letters to take.
_LETTER, _NUMBER, _OTHER, _SPACE, _BLANK, _TAKE1, _TAKE2 = range(7)
# States: what the previous code point leaves open.
_FRESH, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _AFTER_SPACE, _ONE_LEFT, _TWO_LEFT = range(7)

# Code points with the property White_Space.
_WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What the pattern takes after an apostrophe.
_ONE, _TWO = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for k in range(0x110000):
        first = unicodedata.category(chr(k))[0]
        if first == "L":
            out[k] = _LETTER
        elif first == "N":
            out[k] = _NUMBER
    out[_WHITE] = _BLANK
    out[0x20] = _SPACE
    return out


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a token starts at it (blanks are handled apart)."""
    if state == _TWO_LEFT:
        return _ONE_LEFT, False
    if state == _ONE_LEFT:
        return _FRESH, False
    if symbol == _SPACE:
        return _AFTER_SPACE, False
    if symbol == _BLANK:
        return _FRESH, False
    run = {_LETTER: _IN_LETTERS, _NUMBER: _IN_NUMBERS}.get(symbol, _IN_OTHERS)
    starts = state not in (run, _AFTER_SPACE)
    if starts and symbol in (_TAKE1, _TAKE2):
        return (_ONE_LEFT if symbol == _TAKE1 else _TWO_LEFT), True
    return run, starts


# Symbols 8-14 are 0-6 at the start of a text: constant functions, whatever came before.
_NEXT, _STARTS = np.zeros(16 * 8, np.uint8), np.zeros(16 * 8, bool)
for _symbol in range(7):
    for _state in range(7):
        _NEXT[8 * _symbol + _state], _STARTS[8 * _symbol + _state] = _step(_symbol, _state)
        _NEXT[8 * (_symbol + 8) + _state], _STARTS[8 * (_symbol + 8) + _state] = _step(_symbol, _FRESH)
_NEXT[8 * 7 : 8 * 7 + 7] = np.arange(7)  # symbol 7 pads the last block: the identity


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, from ``_FRESH``: an exclusive scan of function composition."""
    n = len(symbols)
    rows = -(-n // _BLOCK)
    row = np.full(rows * _BLOCK, 8 * 7, np.uint8)
    row[:n] = symbols
    row[:n] *= 8
    row = np.ascontiguousarray(row.reshape(rows, _BLOCK).T)  # row[t]: the t-th symbol of every block
    folded = np.repeat(np.arange(7, dtype=np.uint8)[:, None], rows, 1)
    for t in range(_BLOCK):
        folded += row[t]
        folded = _NEXT[folded]
    state, at = _FRESH, np.empty(rows, np.uint8)
    for k, function in enumerate(folded.T.tolist()):
        at[k] = state
        state = function[state]
    before = np.empty((_BLOCK, rows), np.uint8)
    for t in range(_BLOCK):
        before[t] = at
        at = _NEXT[row[t] + at]
    return before.T.reshape(-1)[:n]


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pre-tokens start, in a buffer of texts at ``offsets``.

    Pre-tokens tile each text, so that the next start (or the text's end) ends a token.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    places = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    symbol = _classes()[points]
    n = len(points)
    begins = np.zeros(n + 2, bool)
    begins[np.searchsorted(places, offsets)] = True  # also the end
    begins[n:] = True
    for k in np.flatnonzero(points == ord("'")).tolist():
        one = chr(points[k + 1]) if not begins[k + 1] else ""
        if one and one in _ONE:
            symbol[k] = _TAKE1
        elif one and not begins[k + 2] and one + chr(points[k + 2]) in _TWO:
            symbol[k] = _TAKE2
    marked = symbol + np.uint8(8) * begins[:n]
    starts = _STARTS[np.uint8(8) * marked + _states_before(marked)]
    white = (symbol == _SPACE) | (symbol == _BLANK)
    inner = np.zeros(n, bool)  # blank after a blank of the same text
    inner[1:] = white[:-1] & ~begins[1:n]
    last = np.zeros(n, bool)  # blank before what is no blank, in the same text
    last[:-1] = ~white[1:] & ~begins[1:n]
    starts |= white & (~inner | last)
    return places[starts]


class Tokenizer:
    """Merges by rank of the bytes of a pre-token, with a bounded cache of what was merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, k in ranks.items():
            by_id[k] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the cache until it was last full: what is used again stays

    def merged(self, piece: bytes) -> bytes:
        """Token ids of one pre-token, four bytes each."""
        found = self.cache.get(piece)
        if found is None:
            whole = self.ranks.get(piece)
            if whole is not None:  # found as fast without the cache
                return whole.to_bytes(4, "little")
            found = self.before.get(piece) or array("I", self._short(piece) if len(piece) <= 40 else self._long(piece)).tobytes()
            if len(piece) <= LONGEST_CACHED:
                if len(self.cache) >= CACHE:
                    self.before, self.cache = self.cache, {}
                self.cache[piece] = found
        return found

    def forget(self) -> None:
        """Empty the cache."""
        self.cache, self.before = {}, {}

    def _short(self, piece: bytes) -> list[int]:
        parts, ranks = [piece[k : k + 1] for k in range(len(piece))], self.ranks
        pairs = [ranks.get(parts[k] + parts[k + 1], 1 << 60) for k in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == 1 << 60:
                break
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], 1 << 60)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], 1 << 60)
        return [ranks[p] for p in parts]

    def _long(self, piece: bytes) -> list[int]:
        """The same merges by a heap, for pieces whose length makes rescanning slow."""
        n, ranks = len(piece), self.ranks
        end, following, previous = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            after = following[k]
            if end[k] < 0 or after >= n or end[after] != stop or end[after] < 0:
                continue  # one of the two was merged meanwhile
            end[k], end[after] = stop, -1
            following[k] = following[after]
            if following[k] < n:
                previous[following[k]] = k
                if (r := ranks.get(piece[k : end[following[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[following[k]]))
            if (p := previous[k]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[k : end[k]]] for k in range(n) if end[k] > 0]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (and the end)."""
        starts = pretoken_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        first, which = distinct_spans(data, starts, ends)
        raw = data.tobytes()
        pieces = [self.merged(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        ids = flat[ragged(begin[which], size[which])]
        made = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size[which], out=made[1:])
        return ids, made[np.searchsorted(starts, offsets)]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id's bytes begin in what they decode to, and the end."""
        return np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``.  Raises IndexError for an id that the ranks don't have."""
        return self.blob[ragged(self.places[ids], self.lengths[ids])]


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


@lru_cache(maxsize=2)
def _tokenizer(raw: bytes) -> Tokenizer:
    return Tokenizer(parse_ranks(raw))


def read_ranks(path: str) -> bytes:
    """The driver's copy of a rank file; its size is checked, since executors get it whole."""
    with open(path, "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is over {MAX_RANK_BYTES} bytes")
    return raw


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", docs["text"].cast("string").alias("text"))


def _rows(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[tuple]:
    """Keys, ids and bounds of each chunk.  Idle workers keep their memory while others need it: the task's cache goes with it."""
    try:
        for batch in trimmed(batches):
            for low, high, data, at in chunks(batch.column("text")):
                ids, bounds = tokenizer.encode(data, at)
                yield batch.column("doc_id").slice(low, high - low), ids, bounds
            batch = data = None  # noqa: PLW2901
    finally:
        tokenizer.forget()


def _cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw, width = values.tobytes(), values.dtype.itemsize
    return pa.array([raw[a * width : b * width] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())



def encode_documents(spark: SparkSession, docs: DataFrame, ranks: bytes) -> DataFrame:
    """``(doc_id, n_tokens, ids, offsets)`` of each whole text.

    ``ids`` are little-endian unsigned 32-bit integers; ``offsets`` the byte at which each id's
    bytes begin in the text, in the same form.  Special tokens' strings are ordinary text.  A null or
    empty text has no ids.  Rows are independent: repeated rows, null doc_ids, other columns and
    empty tables need no care.
    """
    shipped = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shipped.value)
        for keys, ids, bounds in _rows(batches, tokenizer):
            made = tokenizer.offsets(ids)
            inside = made[:-1] - np.repeat(made[bounds[:-1]], np.diff(bounds))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.diff(bounds)), _cut(ids.astype("<u4"), bounds), _cut(inside.astype("<u4"), bounds)], ["doc_id", "n_tokens", "ids", "offsets"]
            )

    return _text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, offsets binary")


def decode_documents(spark: SparkSession, encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``(doc_id, decoded)``: the bytes of a table's ``ids``; null ids give null."""
    shipped = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shipped.value)
        for batch in batches:
            found = [tokenizer.decode(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64)).tobytes() if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(spark: SparkSession, docs: DataFrame, ranks: bytes) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: encode every text and decode its ids, in one pass.

    The same as ``decode_documents(encode_documents(docs))`` joined to its input.
    """
    shipped = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shipped.value)
        for keys, ids, bounds in _rows(batches, tokenizer):
            made = tokenizer.offsets(ids)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.diff(bounds)), _cut(ids.astype("<u4"), bounds), _cut(tokenizer.decode(ids), made[bounds])], ["doc_id", "n_tokens", "ids", "decoded"]
            )

    return _text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
