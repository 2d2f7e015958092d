"""GIF columns: a coder, and a decoder for LZW streams, palettes, disposal, transparency and timing.

`encode` writes any bytes as 8-bit samples: frames WIDTH pixels wide, a global palette of 256 greys,
a delay for each frame. `decode` reads any GIF87a/89a of its kind: local and global palettes,
interlace, disposal 0-3, transparent index. `frames` stores one row for each frame, with its time
and a colour histogram.

Edge cases: null and empty texts are one row of 576 bytes of value 255. Truncated or foreign bytes
raise ValueError in `decode`; `frames` gives such rows no frames. Repeated rows are answered one by
one, extra columns are ignored. Very long texts become several frames of at most ROWS rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

WIDTH, ROWS, DELAY = 576, 64, 10
_GREYS = bytes(x for i in range(256) for x in (i, i, i))
_BOOK = 4096


@lru_cache
def _widths(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the k-th code after a clear code, for samples of `depth` bits; and where it starts."""
    first = (1 << depth) + 2
    widths = np.array([depth + 1] + [min(12, max(depth + 1, (first + max(0, k - 2)).bit_length())) for k in range(1, _BOOK + 2)], np.int64)
    return widths, np.concatenate([[0, 0], np.cumsum(widths[1:])])


def lzw_encode(data: bytes) -> bytes:
    """The LZW stream of 8-bit samples; the dictionary starts anew when it is full."""
    codes = [256]
    if data:
        add, book, new = codes.append, {}, 258
        get = book.get
        samples = iter(data)
        word = next(samples)
        for c in samples:
            key = word << 8 | c
            known = get(key)
            if known is not None:
                word = known
                continue
            add(word)
            if new < _BOOK:
                book[key] = new
                new += 1
            else:
                add(256)
                book.clear()
                new = 258
            word = c
        add(word)
    codes.append(257)
    code = np.array(codes, np.uint32)
    at = np.arange(len(code))
    since = at - np.concatenate([[0], np.maximum.accumulate(np.where(code == 256, at, 0))[:-1]])
    widths = _widths(8)[0][since]
    ends = np.cumsum(widths)
    starts = ends - widths
    out = np.zeros(int(ends[-1]) // 8 + 4)
    shifted = code << (starts & 7).astype(np.uint32)
    for k in range(3):  # a code touches three bytes at most, and no two codes share a bit
        out += np.bincount((starts >> 3) + k, (shifted >> np.uint32(8 * k)) & np.uint32(255), len(out))
    return out[: -(-int(ends[-1]) // 8)].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, depth: int) -> bytes:
    """Samples of an LZW stream. Codes are cut out of the bits a span at a time, then looked up."""
    widths, starts = _widths(depth)
    clear, bits = 1 << depth, len(stream) * 8
    data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, book, prev, k = 0, list(roots), b"", 1
    while True:
        n = min(_BOOK, _BOOK + 1 - k) if k <= _BOOK else _BOOK
        w = widths[k : k + n] if k <= _BOOK else np.full(n, 12)
        begin = at + (starts[k : k + n] - starts[k] if k <= _BOOK else 12 * np.arange(n))
        inside = int(np.searchsorted(begin + w, bits, side="right"))
        begin, w = begin[:inside], w[:inside]
        if not inside:
            raise ValueError("LZW stream ends without an end code")
        i = begin >> 3
        code = ((data[i] | data[i + 1] << np.uint32(8) | data[i + 2] << np.uint32(16)) >> (begin & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)
        stops = np.flatnonzero((code == clear) | (code == clear + 1))
        upto = int(stops[0]) if len(stops) else inside
        add, grow, size = out.append, book.append, len(book)
        for c in code[:upto].tolist():
            if c < size:
                entry = book[c]
            elif c == size and prev:
                entry = prev + prev[:1]
            else:
                raise ValueError("LZW code outside the dictionary")
            add(entry)
            if prev and size < _BOOK:
                grow(prev + entry[:1])
                size += 1
            prev = entry
        if len(stops):
            at = int(begin[upto] + w[upto])
            if code[upto] == clear + 1:
                return b"".join(out)
            book, prev, k = list(roots), b"", 1
        else:
            at, k = int(begin[-1] + w[-1]), k + inside


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose pixels are the payload's bytes; the payload is a positive multiple of width."""
    if not payload or len(payload) % width:
        raise ValueError("payload must be a positive multiple of the width")
    height = min(rows, len(payload) // width)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREYS]
    for i in range(0, len(payload), width * rows):
        piece = payload[i : i + width * rows]
        stream = lzw_encode(piece)
        parts += [b"\x21\xf9\x04\x04", struct.pack("<HBB", delay, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(piece) // width, 0), b"\x08"]
        for j in range(0, len(stream), 255):
            block = stream[j : j + 255]
            parts += [bytes([len(block)]), block]
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    samples: bytes
    delay: int = 0
    disposal: int = 0
    transparent: int = -1


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and the frames with their raw samples in row order."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        width, height, flags = struct.unpack_from("<HHB", data, 6)
        at, shared = 13, np.zeros((0, 3), np.uint8)
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        frames, extra = [], {}
        while (kind := data[at]) != 0x3B:
            if kind == 0x21 and data[at + 1] == 0xF9:
                how, delay, clear = struct.unpack_from("<BHB", data, at + 3)
                extra = {"delay": delay, "disposal": how >> 2 & 7, "transparent": clear if how & 1 else -1}
                at = _blocks(data, at + 2)[1]
            elif kind == 0x21:
                at = _blocks(data, at + 2)[1]
            elif kind == 0x2C:
                left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
                at, palette = at + 10, shared
                if local & 0x80:
                    n = 3 << ((local & 7) + 1)
                    palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
                stream, after = _blocks(data, at + 1)
                samples = lzw_decode(stream, data[at])
                at = after
                if len(samples) < w * h:
                    raise ValueError("a frame has too few samples")
                samples = samples[: w * h]
                if local & 0x40:  # interlaced: four passes over the rows
                    order = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, b)]
                    by = np.empty((h, w), np.uint8)
                    by[order] = np.frombuffer(samples, np.uint8).reshape(h, w)
                    samples = by.tobytes()
                frames.append(Frame(left, top, w, h, palette, samples, **extra))
                extra = {}
            else:
                raise ValueError("unknown block")
    except (IndexError, struct.error) as e:
        raise ValueError("truncated GIF") from e
    return width, height, frames


def samples(data: bytes) -> bytes:
    return b"".join(f.samples for f in decode(data)[2])


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The RGBA canvas as shown for each frame: palettes, transparency and disposal applied."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = max(0, min(f.height, height - f.top)), max(0, min(f.width, width - f.left))
        index = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)[:h, :w]
        palette = np.zeros((256, 4), np.uint8)
        palette[: len(f.palette), :3] = f.palette
        palette[:, 3] = 255
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        area[...] = palette[index] if f.transparent < 0 else np.where((index == f.transparent)[..., None], area, palette[index])
        yield canvas
        if f.disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before


#: Bins for each colour channel.
BINS = 8


def histograms(width: int, height: int, frames: list[Frame]) -> list[list[int]]:
    """For each frame as shown: pixels by bin of red, then green, then blue, then those not painted."""
    whole = [f.transparent < 0 and (f.left, f.top, f.width, f.height) == (0, 0, width, height) for f in frames]
    out = []
    if all(whole):  # then a frame hides all before it, and its indices are enough
        for f in frames:
            counts = np.bincount(np.frombuffer(f.samples, np.uint8), minlength=256)
            palette = np.zeros((256, 3), np.uint8)
            palette[: len(f.palette)] = f.palette
            out.append([int(x) for c in range(3) for x in np.bincount(palette[:, c] >> 5, counts, BINS)] + [0])
        return out
    for canvas in composed(width, height, frames):
        painted = canvas[canvas[..., 3] > 0]
        out.append([int(x) for c in range(3) for x in np.bincount(painted[:, c] >> 5, minlength=BINS)] + [width * height - len(painted)])
    return out


def payload_of(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (-len(data) % unit or (unit if not data else 0))


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text stored as a GIF."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):  # small outputs: a batch of very long texts stays small
                part = batch.slice(i, 64)
                pairs = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in pairs], pa.int64()), pa.array([encode(p) for _, p in pairs], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_bytes long, media binary")


def frames(stored_media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each frame of a table with a `media` column: key, frame, start_ms, duration_ms, histogram."""
    prepare(stored_media.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                try:
                    w, h, found = decode(data or b"")
                except ValueError:
                    continue
                start = 0
                for n, (f, hist) in enumerate(zip(found, histograms(w, h, found), strict=True)):
                    keys.append(k.as_py())
                    rows.append((n, start, f.delay * 10, hist))
                    start += f.delay * 10
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))], [key, "frame", "start_ms", "duration_ms", "histogram"])

    kind = dict(stored_media.dtypes)[key]
    return stored_media.select(key, "media").mapInArrow(work, f"{key} {kind}, frame int, start_ms long, duration_ms long, histogram array<long>")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op8: media are written to the shared folder and read back."""
    kept = stored(media(docs), "gif-media")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2):
                data = data.as_py()
                w, h, found = decode(data)
                payload = b"".join(f.samples for f in found)
                hist = np.sum(histograms(w, h, found), axis=0)
                feature = f"{w}x{h};frames={len(found)};ms={10 * sum(f.delay for f in found)};hist=" + ",".join(map(str, hist.tolist()))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return kept.mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
