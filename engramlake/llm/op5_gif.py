"""Media columns for GIF: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

``encode_gif`` stores a payload losslessly as 8-bit samples under a grey palette; ``decode_gif``
reads any GIF87a or GIF89a. Code widths follow from the number of codes since the last clear code,
so the bits of a whole run of codes are packed and unpacked by numpy.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, table

WIDTH, HEIGHT, UNIT, DELAY_CS = 64, 1024, 64, 10
BINS = 16
#: About so many bytes of GIFs are held at a time.
HELD = 8_000_000
_GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    """One frame as shown: the canvas in RGBA (rows, columns, 4), the part it drew (left, top, columns, rows) and how long it stays."""

    canvas: np.ndarray
    box: tuple[int, int, int, int]
    delay_ms: int
    disposal: int

    def histogram(self, bins: int = BINS) -> np.ndarray:
        """Counts of red, green and blue samples of opaque pixels in equal bins, one row per colour."""
        seen = self.canvas[self.canvas[..., 3] > 0]
        return np.array([np.bincount(seen[:, c] // (256 // bins), minlength=bins) for c in range(3)])


#: Bits that a number takes, up to the twelve of a code.
_BITS = np.array([min(12, i.bit_length()) for i in range(8192)])


def _widths(n: int, first: int) -> np.ndarray:
    """Bits of the n codes after a clear code, where first is the number of codes that the palette needs and two more."""
    return _BITS[first - 1 : first - 1 + n]


def lzw_pack(data: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of samples of so many bits: a clear code first and whenever the table is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    runs, codes, table, size = [], [], {}, end + 1
    known = None
    for b in data:
        if known is None:
            known = b
            continue
        key = known << 8 | b
        code = table.get(key)
        if code is not None:
            known = code
            continue
        codes.append(known)
        known = b
        if size < 4096:
            table[key] = size
            size += 1
        else:
            codes.append(clear)
            runs.append(codes)
            codes, table, size = [], {}, end + 1
    if known is not None:
        codes.append(known)
    codes.append(end)
    runs.append(codes)
    every = np.array([clear] + [c for r in runs for c in r], np.uint16)
    width = np.concatenate([[bits + 1], *(_widths(len(r), end + 1) for r in runs)])
    grid = np.unpackbits(every.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(grid[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes.

    Entry j of the table is what code j stands for and the first sample of code j + 1, which is the
    output from where code j starts. So each code is a copy of earlier output; lengths follow the
    chain of entries and samples the chain of positions, both by pointer doubling.
    """
    n = len(codes)
    entry = codes.astype(np.int64) - clear - 2
    fresh = entry < 0
    if n and (not fresh[0] or (codes[fresh] >= clear).any() or (entry >= np.arange(n)).any()):
        raise ValueError("a code that isn't in the table")
    up, size = np.where(fresh, np.arange(n), entry), np.where(fresh, 0, 1)
    while True:
        more = size[up]
        if not more.any():
            break
        size, up = size + more, up[up]
    size += 1
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), size)
    source = np.arange(len(owner))
    copied = ~fresh[owner]
    source[copied] += (start[np.maximum(entry, 0)] - start)[owner[copied]]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return codes.astype(np.uint8)[owner[source]]
        source = further


_RUN = {bits: _widths(4096 - (1 << bits) - 1, (1 << bits) + 2) for bits in range(1, 9)}


def lzw_unpack(stream: bytes, bits: int) -> bytes:
    """The samples of a code stream, up to its end code or its last whole code."""
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    out: list[bytes] = []
    at, total = 0, 8 * len(stream)
    while at < total:
        # codes up to the next clear code; a table that is full stays as it is, at twelve bits
        held, width, last = [], _RUN[bits], False
        while not last and at < total:
            width = width[: (total - at) // 2 + 1]
            ends = at + np.cumsum(width)
            ends = ends[ends <= total]
            if not len(ends):
                at = total
                break
            width = width[: len(ends)]
            begin = ends - width
            byte = begin >> 3
            codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (begin & 7).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)
            halt = np.flatnonzero((codes == clear) | (codes == end))
            last = len(halt) > 0
            held.append(codes[: halt[0]] if last else codes)
            at = total if last and codes[halt[0]] == end else int(ends[halt[0]] if last else ends[-1])
            width = np.full(4096, 12, np.int64)
        if held:
            out.append(_expand(np.concatenate(held), clear).tobytes())
    return b"".join(out)


def _blocks(b: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (b[i : i + 255] for i in range(0, len(b), 255))) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, height: int = HEIGHT, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF89a whose pixels, frame after frame and row by row, are the payload's bytes under a grey palette.

    The payload's length is a positive multiple of width; each frame has up to height rows, the last fewer.
    """
    rows = len(payload) // width
    out = [b"GIF89a", width.to_bytes(2, "little"), min(height, rows).to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for top in range(0, rows, height):
        part = payload[top * width : (top + height) * width]
        out += [b"\x21\xf9\x04\x04", delay_cs.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(part) // width).to_bytes(2, "little"), b"\0\x08", _blocks(lzw_pack(part))]
    return b"".join([*out, b"\x3b"])


def _palette(b: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.zeros((256, 4), np.uint8)
    colours[:, 3] = 255
    colours[:n, :3] = np.frombuffer(b[at : at + 3 * n], np.uint8).reshape(-1, 3)
    return colours, at + 3 * n


def _lines(rows: int, interlaced: bool) -> np.ndarray:
    """The row of the picture that each stored row is."""
    return np.concatenate([np.arange(a, rows, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))]) if interlaced else np.arange(rows)


def decode_gif(b: bytes) -> Iterator[Frame]:
    """The frames of a GIF, as shown one after another; ValueError if it isn't one."""
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 13:
        raise ValueError("not a GIF")
    canvas = np.zeros((int.from_bytes(b[8:10], "little"), int.from_bytes(b[6:8], "little"), 4), np.uint8)
    at, shared = 13, None
    if b[10] & 128:
        shared, at = _palette(b, at, b[10])
    disposal, clear, delay = 0, -1, 0

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while b[at]:
            parts.append(b[at + 1 : at + 1 + b[at]])
            at += 1 + b[at]
        return b"".join(parts), at + 1

    while at < len(b) and b[at] != 0x3B:
        if b[at] == 0x21:
            kind = b[at + 1]
            body, at = joined(at + 2)
            if kind == 0xF9:
                disposal, clear, delay = body[0] >> 2 & 7, body[3] if body[0] & 1 else -1, int.from_bytes(body[1:3], "little")
        elif b[at] == 0x2C:
            left, top, columns, rows = (int.from_bytes(b[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
            flags, at, colours = b[at + 9], at + 10, shared
            if flags & 128:
                colours, at = _palette(b, at, flags)
            if colours is None:
                raise ValueError("a frame without a palette")
            bits = b[at]
            stream, at = joined(at + 1)
            samples = np.frombuffer(lzw_unpack(stream, bits), np.uint8)[: rows * columns]
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + rows, left : left + columns]
            if len(samples) == rows * columns and clear < 0 and not flags & 64 and part.shape[:2] == (rows, columns):
                part[:] = colours[samples.reshape(rows, columns)]
            else:
                drawn = np.zeros((rows, columns), np.uint8)
                mask = np.zeros((rows, columns), bool)
                drawn.reshape(-1)[: len(samples)], mask.reshape(-1)[: len(samples)] = samples, samples != clear
                order = np.argsort(_lines(rows, bool(flags & 64)))
                drawn, mask = drawn[order][: part.shape[0], : part.shape[1]], mask[order][: part.shape[0], : part.shape[1]]
                part[mask] = colours[drawn[mask]]
            yield Frame(canvas.copy(), (left, top, columns, rows), delay * 10, disposal)
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = before
            disposal, clear, delay = 0, -1, 0
        else:
            raise ValueError("an unknown block")


def padded(text: str | None) -> tuple[int, bytes]:
    """The length of a text in UTF-8, and its bytes with zeros up to a positive multiple of UNIT."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b + b"\0" * (-len(b) % UNIT or (0 if b else UNIT))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``content``, the GIF of each text's padded bytes; a null text is an empty one.

    Rows are independent, so repeated rows repeat. A text of any length is one GIF; about HELD bytes of
    GIFs are held at a time, or a longer one alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, media, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            nonlocal keys, sizes, media, held
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "content"])
            keys, sizes, media, held = [], [], [], 0
            return out

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, payload = padded(text.as_py())
                keys.append(key)
                sizes.append(n)
                media.append(encode_gif(payload))
                held += len(media[-1])
                if held > HELD:
                    yield batch()
        yield batch()

    return arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, content binary")


FRAME = "frame_no int, delay_ms int, disposal int, width int, height int, pixels binary, red array<long>, green array<long>, blue array<long>"


def gif_frames(media: DataFrame, key: str = "media_id", content: str = "content") -> DataFrame:
    """A row for each frame of each GIF: key, frame_no, delay_ms, disposal, width, height, pixels (the shown canvas in RGBA) and the colour histograms red, green and blue.

    What isn't a GIF, and null, has no frames; one that breaks off keeps the frames before. Repeated rows repeat,
    an empty table gives none; frames are made one at a time, so a long GIF holds one canvas.
    """
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column(0), b.column(1), strict=True):
                try:
                    for i, f in enumerate(decode_gif(c.as_py() or b"")):
                        rows, columns = f.canvas.shape[:2]
                        h = f.histogram()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k.as_py()], b.schema.field(0).type), *(pa.array([v], pa.int32()) for v in (i, f.delay_ms, f.disposal, columns, rows)), pa.array([f.canvas.tobytes()], pa.binary()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in h)],
                            [key, "frame_no", "delay_ms", "disposal", "width", "height", "pixels", "red", "green", "blue"],
                        )
                except (ValueError, IndexError):
                    continue

    return arrow(media.select(key, content), run, f"`{key}` {kind}, {FRAME}")


def stored_payload(content: bytes) -> tuple[bytes, np.ndarray, int]:
    """The samples that the frames of a stored GIF drew, in order; their histogram; the number of frames."""
    parts, hist, n = [], np.zeros(BINS, np.int64), 0
    for f in decode_gif(content):
        drawn = np.ascontiguousarray(f.canvas[: f.box[3], : f.box[2], 0])
        parts.append(drawn.tobytes())
        hist += np.bincount(drawn.reshape(-1) // (256 // BINS), minlength=BINS)
        n += 1
    return b"".join(parts), hist, n


def media_digests(media: DataFrame) -> DataFrame:
    """For doc_id, n_bytes and content: digests of the payload read back from the frames, of the stored form, and the feature (grey histogram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c in b.column(2):
                content = c.as_py()
                payload, hist, n = stored_payload(content)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(content), hashlib.sha256(content).hexdigest(), ",".join(map(str, hist.tolist())), n))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames"])

    return arrow(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long")


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store_texts(table(spark, sf_dir, "documents")))
