"""GIF images as media columns: LZW code streams, palettes, disposal, transparency, timed frames.

``encode`` stores 8-bit samples losslessly as palette indexes; ``decode`` reads any GIF87a/89a:
it expands the LZW streams, undoes interlacing, applies local or global palettes, draws each
frame on the canvas under its transparency rule and disposes of it as the file asks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import chunks, ragged

WIDTH, ROWS = 64, 1024  # samples in a row; rows of a frame at most
DELAY = 10  # hundredths of a second
BINS = 16
_CLEAR, _END, _FULL = 256, 257, 4096
_SEGMENT, _HEAD = 3838, 254  # codes that fill the table; single codes at a segment's start


def _widths(size: int, n: int) -> np.ndarray:
    """Bits of the n-th code after a clear code, for a minimum code size of ``size``."""
    free = (1 << size) + 1 + np.arange(n)  # the largest code that the reader knows by then
    free[0] -= 1
    return np.minimum(12, np.maximum(size + 1, np.floor(np.log2(np.maximum(free, 1))).astype(np.int64) + 1))


_WIDTHS = {size: _widths(size, 2 * _FULL) for size in range(2, 9)}


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    at = ends - widths
    value = codes << (at & 7)
    n = (int(ends[-1]) + 7) // 8
    out = np.zeros(n + 3, np.int64)
    for k in range(3):
        out += np.bincount((at >> 3) + k, (value >> (8 * k)) & 255, n + 3).astype(np.int64)
    return out[:n].astype(np.uint8).tobytes()


def _segment(samples: np.ndarray) -> tuple[np.ndarray, int]:
    """The codes from one clear code to the next, and how many samples they hold.

    The first ``_HEAD`` samples are single codes, by which the reader's table learns their
    pairs; after them every known pair is one code.  That needs no search sample by sample.
    """
    head = samples[: _HEAD + 1].astype(np.int64)
    if len(samples) <= _HEAD:
        return head, len(head)
    known = np.zeros(1 << 16, np.int64)
    known[head[:-1] << 8 | head[1:]] = _END + 1 + np.arange(_HEAD)
    tail = samples[_HEAD : _HEAD + 2 * (_SEGMENT - _HEAD)].astype(np.int64)
    pair = np.zeros(len(tail), np.int64)
    pair[:-1] = known[tail[:-1] << 8 | tail[1:]]
    held = pair > 0
    place = np.arange(len(tail))
    fresh = held.copy()
    fresh[1:] &= ~held[:-1]
    run = np.maximum.accumulate(np.where(fresh, place, 0))
    double = held & ((place - run) % 2 == 0)
    single = ~double
    single[1:] &= ~double[:-1]
    starts = np.flatnonzero(double | single)[: _SEGMENT - _HEAD]
    codes = np.where(double[starts], pair[starts], tail[starts])
    used = int(starts[-1]) + 1 + int(double[starts[-1]])
    return np.concatenate((head[:_HEAD], codes)), _HEAD + used


def lzw_encode(samples: bytes) -> bytes:
    """The LZW code stream of 8-bit samples, with a clear code whenever the table is full."""
    rest, codes, widths = np.frombuffer(samples, np.uint8), [[_CLEAR]], [[9]]
    while len(rest):
        part, used = _segment(rest)
        rest = rest[used:]
        codes += [part, [_CLEAR if len(rest) else _END]]
        widths.append(_WIDTHS[8][: len(part) + 1])
    if len(codes) == 1:
        codes.append([_END])
        widths.append([9])
    return _pack(np.concatenate(codes), np.concatenate(widths))


def _expanded(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of one segment's codes.

    A code beyond the single samples stands for the string of the code that made its table
    entry and the first sample of the next one: for samples that lie side by side in the
    output.  So every sample points to an earlier one, and pointers are followed all at once.
    """
    n, place = len(codes), np.arange(len(codes))
    single = codes < clear
    maker = np.where(single, place, codes - clear - 2)
    if (maker >= place + single).any() or (maker < 0).any():
        raise ValueError("LZW code that is not in the table yet")
    size, up = (~single).astype(np.int64), maker  # steps to a single sample; where as many lead
    while (step := size[up]).any():
        size, up = size + step, up[up]
    size += 1
    ends = np.cumsum(size)
    starts = ends - size
    at = ragged(starts[maker], size)
    sample = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    sample[starts[single]] = codes[single]
    known = np.zeros(len(sample), bool)
    known[starts[single]] = True
    while not known[at].all():
        at = at[at]
    return sample[at]


def lzw_decode(stream: bytes, size: int, expected: int) -> np.ndarray:
    """The samples of a code stream with minimum code size ``size``; at most ``expected``.

    Codes are read a segment at a time: between two clear codes a code's width follows from
    its place alone.  Raises ValueError for a code that the table can't have.
    """
    data = np.zeros(len(stream) + 4, np.int64)
    data[: len(stream)] = np.frombuffer(stream, np.uint8)
    clear, end, total = 1 << size, (1 << size) + 1, 8 * len(stream)
    out: list[np.ndarray] = []
    bit, made, over = 0, 0, False
    while not over and made < expected:
        segment: list[np.ndarray] = []
        at, restart = 0, False
        while not (restart or over):
            known = _WIDTHS[size][at : at + _FULL] if at < _FULL else np.full(_FULL, 12)  # 12 bits once the table is full
            ends = bit + np.cumsum(known)
            n = int(np.searchsorted(ends, total, "right"))
            starts = ends[:n] - known[:n]
            place = starts >> 3
            codes = ((data[place] | data[place + 1] << 8 | data[place + 2] << 16) >> (starts & 7)) & ((1 << known[:n]) - 1)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop):
                restart, over = True, int(codes[stop[0]]) == end
                n = int(stop[0])
                bit = int(ends[n])
            else:
                over = n < len(known)
                bit, at = int(ends[n - 1]) if n else bit, at + n
            segment.append(codes[:n])
            if at > expected:
                over = True
        one = np.concatenate(segment)
        if len(one):
            out.append(_expanded(one, clear))
            made += len(out[-1])
    return np.concatenate(out)[:expected] if out else np.zeros(0, np.uint8)


def _blocks(raw: bytes) -> bytes:
    return b"".join(bytes([len(raw[k : k + 255])]) + raw[k : k + 255] for k in range(0, len(raw), 255)) + b"\0"


def palette() -> np.ndarray:
    """256 different colours: red is the sample, green and blue spread it."""
    k = np.arange(256)
    return np.stack([k, k * 73 % 256, k * 151 % 256], axis=1).astype(np.uint8)


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF of ``samples`` (a positive multiple of ``width``), in frames of up to ``rows`` rows."""
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", palette().tobytes()]
    for k in range(0, len(samples), width * rows):
        part = samples[k : k + width * rows]
        out += [
            b"\x21\xf9\x04\x04" + delay.to_bytes(2, "little") + b"\0\0",  # disposal 1: leave in place; nothing transparent
            b"\x2c\0\0\0\0" + width.to_bytes(2, "little") + (len(part) // width).to_bytes(2, "little") + b"\0\x08",
            _blocks(lzw_encode(part)),
        ]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One image of a GIF: its samples as stored, its place, and the canvas once it is drawn."""

    left: int
    top: int
    samples: np.ndarray  # rows x columns of palette indexes
    palette: np.ndarray  # colours x 3
    delay: int = 0  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None
    canvas: np.ndarray | None = field(default=None, repr=False)  # rows x columns x RGBA

    def histogram(self, bins: int = BINS) -> np.ndarray:
        """Counts by level of red, green and blue of the opaque pixels of the canvas, 3 x ``bins`` (a
        divisor of 256)."""
        shown = self.canvas[..., 3] > 0
        return np.stack([np.bincount(self.canvas[..., c][shown], minlength=256).reshape(bins, -1).sum(axis=1) for c in range(3)])


def _read_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(raw) and raw[at]:
        parts.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(parts), at + 1


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(raw: bytes, draw: bool = True) -> list[Frame]:
    """The frames of a GIF in order.  Without ``draw`` the canvases stay None.

    Raises ValueError for what is no GIF.  Missing samples of a cut-off stream are 0.
    """
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        raise ValueError("not a GIF")
    width, height = int.from_bytes(raw[6:8], "little"), int.from_bytes(raw[8:10], "little")
    at, common = 13, np.zeros((0, 3), np.uint8)

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        found = np.frombuffer(raw[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
        return found, at + 3 * n

    if raw[10] & 0x80:
        common, at = colours(raw[10], at)
    frames: list[Frame] = []
    canvas = np.zeros((height, width, 4), np.uint8) if draw else None
    delay, disposal, transparent = 0, 0, None
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            label = raw[at + 1] if at + 1 < len(raw) else 0
            body, at = _read_blocks(raw, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
        elif raw[at] == 0x2C and at + 10 < len(raw):
            left, top, w, h = (int.from_bytes(raw[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
            flags, at, table = raw[at + 9], at + 10, common
            if flags & 0x80:
                table, at = colours(flags, at)
            size = raw[at] if at < len(raw) else 0
            if not 2 <= size <= 8:
                raise ValueError(f"LZW minimum code size {size}")
            stream, at = _read_blocks(raw, at + 1)
            samples = np.zeros(w * h, np.uint8)
            got = lzw_decode(stream, size, w * h)
            samples[: len(got)] = got
            samples = samples.reshape(h, w)
            if flags & 0x40:
                straight = np.empty_like(samples)
                straight[_interlaced(h)] = samples
                samples = straight
            frame = Frame(left, top, samples, table, delay, disposal, transparent)
            if draw:
                before = canvas.copy() if disposal == 3 else None
                box = canvas[top : top + h, left : left + w]
                part = samples[: box.shape[0], : box.shape[1]]
                full = np.zeros((256, 4), np.uint8)
                full[: len(table), :3], full[:, 3] = table, 255
                shown = np.ones(part.shape, bool) if transparent is None else part != transparent
                box[shown] = full[part[shown]]
                frame.canvas = canvas.copy()
                if disposal == 2:
                    box[...] = 0
                elif disposal == 3:
                    canvas = before
            frames.append(frame)
            delay, disposal, transparent = 0, 0, None
        else:
            break
    return frames


def payload(text: bytes) -> bytes:
    """``text`` with bytes 0 up to the next positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, at in chunks(batch.column("text")):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            media = [encode(payload(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )


def store_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text as UTF-8, padded and stored as a GIF.

    A null or empty text is 64 bytes 0.  Rows are independent: repeated rows, null doc_ids and an
    empty table need no care.  A long text becomes several frames.  Other columns are not read.
    """
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _frames(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "frame", "start_ms", "delay_ms", "left", "top", "width", "height", "disposal", "transparent", "samples", "red", "green", "blue", "fault"]
        for batch in batches:
            for key, raw in zip(batch.column("doc_id"), batch.column("media")):
                rows, now = [], 0
                try:
                    for k, f in enumerate(decode(raw.as_py()) if raw.is_valid else []):
                        h, w = f.samples.shape
                        rows.append([key.as_py(), k, now, 10 * f.delay, f.left, f.top, w, h, f.disposal, f.transparent, f.samples.tobytes(), *f.histogram(bins).tolist(), None])
                        now += 10 * f.delay
                except ValueError as e:
                    rows = [[key.as_py(), *[None] * 13, str(e)]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _FRAME_TYPES)], names)

    return run


_COUNTS = pa.list_(pa.int64())
_FRAME_TYPES = [pa.int64()] + [pa.int32()] * 9 + [pa.binary()] + [_COUNTS] * 3 + [pa.string()]


def frames(media: DataFrame, bins: int = BINS) -> DataFrame:
    """Timed frames of a ``(doc_id, media)`` table: place, time, rules, stored samples and the
    canvas's colour histogram by channel.  A null media gives no row; what can't be decoded gives
    one row with nothing but doc_id and fault."""
    return media.select("doc_id", "media").mapInArrow(
        _frames(bins),
        "doc_id long, frame int, start_ms int, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, samples binary, red array<long>, green array<long>, blue array<long>, fault string",
    )


def summary(raw: bytes, bins: int = BINS) -> tuple[int, str, int, str]:
    """What is read back from stored media: payload's length, SHA-256, CRC-32 of its last 64
    bytes, and the feature: number of frames, playing time and, summed over the frames as they
    are shown, the canvas's histogram of each colour channel."""
    sha, tail, n, counts, time = hashlib.sha256(), b"", 0, np.zeros((3, bins), np.int64), 0
    found = decode(raw)
    for f in found:
        part = f.samples.tobytes()
        sha.update(part)
        tail, n, time = (tail + part)[-64:], n + len(part), time + 10 * f.delay
        counts += f.histogram(bins)
    channels = ";".join(f"{name}={','.join(map(str, row))}" for name, row in zip(("red", "green", "blue"), counts.tolist()))
    return n, sha.hexdigest(), zlib.crc32(tail), f"frames={len(found)};ms={time};{channels}"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [summary(x.as_py()) for x in batch.column("media")]
        size = [len(x.as_buffer()) for x in batch.column("media")]
        sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("media")]
        n, payload_sha, crc, feature = ([f[k] for f in found] for k in range(4))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(payload_sha, pa.string()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(feature, pa.string())],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _summaries(_store(iter([batch])))


def media_digests(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back and digest what was read.

    The same as digests of ``store_texts``, in one pass over each Arrow batch.
    """
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(
        _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
