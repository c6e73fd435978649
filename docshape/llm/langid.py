"""Language ID by unigram piece models with the segmentation summed out.

Each language has one probability per piece of a fixed public vocabulary.  A word's probability
is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities:
a forward pass over its bytes.  The piece probabilities are fitted by expectation maximisation
(the same sum, forward and backward).  A text's score is the sum of its words' log
probabilities; the answer is the language with the largest, its score the posterior under
equal priors.

Pieces never cross words, so each distinct word of a chunk is scored once, all words of the
chunk together, one byte position at a time.  Words and pieces may have any length: sums are kept in
logarithms, and a word of a script without spaces is one lattice like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import CHUNK, Rolling, chunks, distinct_spans, mix, ragged, utf8, words

#: About so many documents of each language are read for fitting, whatever the corpus has.
SAMPLE_PER_LANGUAGE = 600
ROUNDS, FLOOR = 5, 1e-7
#: Prefix lengths by which long pieces are looked for only where one can begin.
_HINTS = (8, 16)

# a-z and all bytes of other scripts make words; everything else separates them.
_WORD = np.zeros(256, bool)
_WORD[97:123] = True
_WORD[128:] = True


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, each word behind one space; starts and ends of the words,
    the space included; and the number of the first word of each text, and of all."""
    raw = [b" " + t.lower().encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    inside = _WORD[data]
    data = np.where(inside, data, np.uint8(32))
    starts, ends, bounds = words(data, offsets, _WORD)
    return data, starts - 1, ends, bounds


class _Table:
    """Finds strings of one length by hash.  A string whose slot is taken goes to a further, smaller level."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, none: int):
        self.none, self.levels = none, []
        while len(hashes):
            bits = max(10, int(len(hashes)).bit_length() + 5)
            factor = mix(np.array([len(self.levels) + 1], np.uint64))[0] | np.uint64(1)
            slot = ((hashes * factor) >> np.uint64(64 - bits)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            keys, held = np.zeros(1 << bits, np.uint64), np.full(1 << bits, none, np.int32)
            keys[slot[first]], held[slot[first]] = hashes[first], ids[first]
            self.levels.append((keys, held, factor, np.uint64(64 - bits)))
            rest = np.ones(len(hashes), bool)
            rest[first] = False
            hashes, ids = hashes[rest], ids[rest]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.none, np.int64)
        for keys, held, factor, shift in self.levels:
            slot = ((hashes * factor) >> shift).astype(np.int64)
            hit = np.flatnonzero(keys[slot] == hashes)
            out[hit] = np.minimum(out[hit], held[slot[hit]])
        return out


class _Lookup:
    """Finds all pieces in words: a table for each length, and tables of the long ones' prefixes."""

    def __init__(self, pieces: list[bytes]):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(size) - size
        rolling = Rolling(data)
        self.n = len(pieces)
        self.tables, self.hints = {}, {}
        for length in sorted(set(size.tolist())):
            own = np.flatnonzero(size == length)
            self.tables[length] = _Table(rolling.spans(starts[own], starts[own] + length), own, self.n)
        for length in _HINTS:
            own = starts[size > length]
            if len(own):
                hashes = np.unique(rolling.spans(own, own + length))
                self.hints[length] = _Table(hashes, np.zeros(len(hashes), np.int64), 1)

    def edges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(word, begin, end, piece)`` of every piece in every word, by end and then by length."""
        size = ends - starts
        rolling, place = Rolling(data), ragged(starts, size)
        word = np.repeat(np.arange(len(size)), size)
        left = ends[word] - place
        found = []
        for length, table in self.tables.items():
            for hint in [h for h in self.hints if h < length and h not in found]:
                live = np.flatnonzero(left > hint)
                live = live[self.hints[hint](rolling.spans(place[live], place[live] + hint)) == 0]
                place, word, left = place[live], word[live], left[live]
                found.append(hint)
            live = np.flatnonzero(left >= length)
            piece = table(rolling.spans(place[live], place[live] + length))
            hit = np.flatnonzero(piece < self.n)
            begin = (place[live[hit]] - starts[word[live[hit]]]).astype(np.int64)
            found.append((word[live[hit]], begin, begin + length, piece[hit]))
        every = [np.concatenate(c) for c in zip(*(f for f in found if isinstance(f, tuple)))]
        order = np.lexsort((every[1], every[2]))
        return tuple(c[order] for c in every)


class _Lattice:
    """All segmentations of some words, as edges between places; sums are taken in logarithms."""

    def __init__(self, lookup: _Lookup, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        word, begin, end, piece = lookup.edges(data, starts, ends)
        size = ends - starts
        self.first = np.cumsum(size + 1) - size - 1
        self.last = self.first + size
        # three small integers for each edge: fitting keeps the edges of its whole sample
        self.source, self.target, self.piece = (x.astype(np.int32) for x in (self.first[word] + begin, self.first[word] + end, piece))
        # edges of one end and length belong to different words: they are summed together
        new = np.flatnonzero(np.concatenate(([True], (end[1:] != end[:-1]) | (begin[1:] != begin[:-1])))[: len(end)])
        self.steps = list(zip(new.tolist(), np.append(new[1:], len(end)).tolist()))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log sums over the segmentations of every prefix; ``logs`` has a row for each piece."""
        out = np.full((int(self.last[-1]) + 1, *logs.shape[1:]), -np.inf)
        out[self.first] = 0
        for a, b in self.steps:
            to = self.target[a:b]
            out[to] = np.logaddexp(out[to], out[self.source[a:b]] + logs[self.piece[a:b]])
        return out

    def backward(self, logs: np.ndarray) -> np.ndarray:
        out = np.full((int(self.last[-1]) + 1, *logs.shape[1:]), -np.inf)
        out[self.last] = 0
        for a, b in reversed(self.steps):
            at = self.source[a:b]
            out[at] = np.logaddexp(out[at], out[self.target[a:b]] + logs[self.piece[a:b]])
        return out


@dataclass
class Model:
    """Pieces and, for each language, their probabilities."""

    languages: list[str]
    pieces: list[bytes]
    probability: np.ndarray  # pieces x languages
    _lookup: _Lookup | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_lookup": None}

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probabilities of the words, by language."""
        if self._lookup is None:
            self._lookup = _Lookup(self.pieces)
        lattice = _Lattice(self._lookup, data, starts, ends)
        with np.errstate(divide="ignore"):
            return lattice.forward(np.log(self.probability))[lattice.last]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log probabilities of whole texts, by language."""
        data, starts, ends, bounds = _words_of(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if len(starts):
            first, which = distinct_spans(data, starts, ends)
            each = self.word_scores(data, starts[first], ends[first])[which]
            full = np.flatnonzero(bounds[1:] > bounds[:-1])
            out[full] = np.add.reduceat(each, bounds[:-1][full])
        return out


def _within_words(piece: bytes) -> bool:
    """Whether a word, behind its space, can hold a piece."""
    return bool(piece) and bool(_WORD[list(piece[1:])].all()) and (piece[0] == 32 or bool(_WORD[piece[0]]))


#: Words of one lattice in fitting: what is built at a time is small.
_WORDS = 8192


def fit(counts: dict[str, dict[bytes, int]], vocabulary: list[bytes], rounds: int = ROUNDS) -> Model | None:
    """A model of the languages' word counts; words come with their leading space.

    Only pieces that occur in the words are kept, and all single bytes, which no language gives
    less than ``FLOOR``: any word has a segmentation.  None without any word.
    """
    tables = {}
    for language, own in counts.items():
        words = sorted(own)
        tables[language] = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]), np.array([own[w] for w in words], float)
    return fit_words(tables, vocabulary, rounds)


def fit_words(tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], vocabulary: list[bytes], rounds: int = ROUNDS) -> Model | None:
    """As ``fit``; of each language the bytes of its words, their offsets and their counts."""
    languages = sorted(k for k, (_, _, n) in tables.items() if len(n))
    if not languages:
        return None

    def parts(language: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        data, at, _ = tables[language]
        for low in range(0, len(at) - 1, _WORDS):
            edges = at[low : low + _WORDS + 1]
            yield data[edges[0] : edges[-1]], edges[:-1] - edges[0], edges[1:] - edges[0]

    possible = sorted({bytes([k]) for k in range(256)} | {p for p in vocabulary if _within_words(p)})
    lookup = _Lookup(possible)
    used = np.array([len(p) == 1 for p in possible])
    for language in languages:
        for part in parts(language):
            used[lookup.edges(*part)[3]] = True
    pieces = [p for p, u in zip(possible, used.tolist()) if u]
    single = np.array([len(p) == 1 for p in pieces])
    table = np.zeros((len(pieces), len(languages)))
    lookup = _Lookup(pieces)
    for column, language in enumerate(languages):
        lattices = [_Lattice(lookup, *part) for part in parts(language)]
        log_weight = np.log(tables[language][2])
        chance = np.where(single, 1.0, 0.5) / len(pieces)
        for _ in range(rounds):
            with np.errstate(divide="ignore"):
                logs = np.log(chance)
            expected = np.zeros(len(pieces))
            for k, lattice in enumerate(lattices):
                ahead, back = lattice.forward(logs), lattice.backward(logs)
                own = log_weight[k * _WORDS : (k + 1) * _WORDS] - ahead[lattice.last]
                share = ahead[lattice.source] + logs[lattice.piece] + back[lattice.target] + own[np.searchsorted(lattice.last, lattice.target)]
                expected += np.bincount(lattice.piece, np.exp(share), len(pieces))
            chance = expected / expected.sum()
            chance[single] = np.maximum(chance[single], FLOOR)
        table[:, column] = chance
    return Model(languages, pieces, table)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, bytes], int] = {}
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            data, starts, ends, _ = _words_of([text])
            raw = data.tobytes()
            for a, b in zip(starts.tolist(), ends.tolist()):
                key = language, raw[a:b]
                found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"]
        )


def train(spark: SparkSession, docs: DataFrame, vocabulary: list[bytes], *, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Fit on a sample of ``docs`` (text, lang): about ``per_language`` whole texts of each
    language, those with the smallest hashes of the text, so that the fit costs the same for any
    corpus.  Rows with a null lang or text are left out."""
    held = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in held.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = held.where(place < share[F.col("lang")]).select("lang", "text")
    tally = sample.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = tally.toArrow().combine_chunks()  # the words of the sample
    tables = {}
    for language in sorted(sizes):
        own = found.filter(pc.equal(found["lang"], language))
        own = own.take(pc.sort_indices(own["word"]))
        data, at = utf8(own["word"].combine_chunks())
        tables[language] = data, at, own["n"].to_numpy().astype(float)
    return fit_words(tables, vocabulary)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, at in chunks(batch.column("text"), CHUNK):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                language, score = [], []
                points = model.scores(texts) if model else np.zeros((len(texts), 0))
                for text, row in zip(texts, points):
                    if not len(row) or not any(map(str.isalpha, text)):
                        language.append("und")
                        score.append(0.0)
                    else:
                        best = int(np.argmax(row))
                        language.append(model.languages[best])
                        score.append(float(1 / np.exp(row - row[best]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(language, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each whole text.

    ``und`` with score 0 if the text is null, has no letter, or nothing was learned.  Ties go to the
    first language by name.  Only doc_id and text are read, and doc_id is only carried along;
    repeated rows, null doc_ids and empty tables need no care.
    """
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
