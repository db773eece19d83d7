"""GIF media columns: decode LZW code streams, apply palettes, disposal and transparency, keep timed frames.

:func:`decode_gif` is a complete GIF87a/89a reader: global and local palettes, interlacing, sub-block
streams, deferred clear codes, graphic-control delays, transparency, and the disposal methods (keep,
restore to background, restore to previous). :func:`gif_frames` turns a table of GIF bytes into one row for
each frame with its start and duration in milliseconds, its composited pixels and a colour histogram.

:func:`store_bytes` is the lossless container of arbitrary bytes: each byte is the colour index of one pixel of
a 64 pixel wide animation under a 256-step grey palette, so the decoded red samples are the bytes again.

Defined results: null text = empty text (64 zero bytes); null or undecodable media give no frames and the
reason in `error`; every frame has at most 4096 rows, longer payloads use further frames; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow_map, ids_and_texts, read_table, real_id

WIDTH, FRAME_ROWS, DELAY_CS = 64, 4096, 10
MAX_CODES = 4096


class GifError(ValueError):
    pass


# --- LZW ------------------------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _width_schedule(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit widths of the codes after a clear code, as the reader expects them, and their start bits.

    After k codes the reader's table has clear + 1 + k entries (the first code adds none)."""
    clear = 1 << min_size
    k = np.arange(2 * MAX_CODES)
    entries = np.minimum(clear + 2 + np.maximum(k - 1, 0), MAX_CODES)
    width = np.maximum(min_size + 1, np.ceil(np.log2(entries + 1)).astype(np.int64)).clip(max=12)
    return width, np.concatenate([[0], np.cumsum(width)])


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """Greedy variable-width LZW; the table is cleared when it is full."""
    clear = 1 << min_size
    codes: list[int] = [clear]
    emit = codes.append
    table: dict[int, int] = {}
    known, fresh = table.get, clear + 2
    starts: list[int] = [0]  # where in codes each segment (a clear code and what follows) begins
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = known(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        if fresh < MAX_CODES:
            table[key] = fresh
            fresh += 1
        else:
            starts.append(len(codes))
            emit(clear)
            table.clear()
            fresh = clear + 2
        prefix = byte
    if prefix >= 0:
        emit(prefix)
    emit(clear + 1)
    schedule, _ = _width_schedule(min_size)
    widths = np.empty(len(codes), np.int64)
    for a, b in zip(starts, starts[1:] + [len(codes)]):
        # a clear code that ends a full segment is itself read at that segment's width
        widths[a] = min_size + 1 if a == 0 else schedule[a - last - 1]
        widths[a + 1 : b] = schedule[: b - a - 1]
        last = a
    return pack_codes(np.array(codes, np.uint16), widths)


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given bit widths, least significant bit first."""
    out = []
    for at in range(0, len(codes), 1 << 16):
        # whole groups only: carry is avoided by packing bits of a slice and gluing at bit level
        bits = (codes[at : at + (1 << 16), None] >> np.arange(12, dtype=np.uint16)) & 1
        out.append(bits[np.arange(12) < widths[at : at + (1 << 16), None]].astype(np.uint8))
    return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def _segments(stream: bytes, min_size: int):
    """The code segments of a stream: what lies between clear codes, unpacked a segment at a time."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    schedule, starts = _width_schedule(min_size)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, bit = 8 * len(stream), 0

    def unpack(at: np.ndarray, widths) -> np.ndarray:
        byte = at >> 3
        word = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
        return (word >> (at & 7).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)).astype(np.int64)

    while bit + min_size + 1 <= total:
        n = int(np.searchsorted(starts, total - bit, side="right")) - 1
        codes = unpack(bit + starts[:n], schedule[:n])
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop) and n == len(schedule):  # a deferred clear: the table stays full, codes keep 12 bits
            tail = bit + int(starts[n])
            more = np.arange((total - tail) // 12)
            codes = np.concatenate([codes, unpack(tail + 12 * more, np.full(len(more), 12))])
            stop = np.flatnonzero((codes == clear) | (codes == end))
        if not len(stop):
            yield codes
            return
        used = int(stop[0])
        if used:
            yield codes[:used]
        if codes[used] == end:
            return
        bit += int(starts[used + 1]) if used + 1 < len(starts) else int(starts[-1]) + 12 * (used + 1 - len(schedule))


#: Codes that are expanded together.
EXPAND_CODES = 1 << 16


def _expand(segments: list[np.ndarray], clear: int) -> bytes:
    """The strings of all codes. A code's string is that of an earlier occurrence plus the first byte of the
    occurrence after it, so depths and roots come from pointer doubling and bytes are written back to front."""
    sizes = np.array([len(x) for x in segments])
    codes = np.concatenate(segments)
    at = np.arange(len(codes))
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    literal = codes < clear
    ref = np.where(literal, at, begin + codes - (clear + 2))
    if (~literal & (ref + 1 > at)).any() or (codes >= MAX_CODES).any():
        raise GifError("an LZW code lies beyond the table")
    root, depth = ref, (~literal).astype(np.int64)
    while True:
        further = root[root]
        if (further == root).all():
            break
        depth, root = depth + depth[root], further
    first = codes[root]
    last = np.where(literal, codes, first[np.minimum(ref + 1, len(codes) - 1)]).astype(np.uint8)
    ends = np.cumsum(depth + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    place, node = ends - 1, at
    while len(node):
        out[place] = last[node]
        go = ~literal[node]
        place, node = place[go] - 1, ref[node[go]]
    return out.tobytes()


def lzw_decode(stream: bytes, min_size: int, expected: int) -> bytes:
    """Decode one code stream; stops at the end code, at `expected` bytes or when the stream ends."""
    if not 1 <= min_size <= 8:
        raise GifError(f"LZW code size {min_size}")
    parts, made, held, waiting = [], 0, [], 0
    for codes in _segments(stream, min_size):
        held.append(codes)
        waiting += len(codes)
        if waiting >= EXPAND_CODES:
            parts.append(_expand(held, 1 << min_size))
            made, held, waiting = made + len(parts[-1]), [], 0
            if made >= expected:
                break
    if held:
        parts.append(_expand(held, 1 << min_size))
    return b"".join(parts)[:expected]


# --- container ------------------------------------------------------------------------------------------


@dataclass
class Frame:
    index: int
    start_ms: int
    duration_ms: int
    pixels: np.ndarray  # height x width x 3, composited on the canvas
    samples: np.ndarray  # the frame's own colour indexes, height x width
    disposal: int
    transparent: int | None


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("the stream ends inside a block")
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 * (2 << (flags & 7))
    if at + n > len(data):
        raise GifError("the stream ends inside a palette")
    return np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n


def _rows_of_interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


#: A canvas beyond so many pixels is refused with an error: a header of a few bytes can claim 4 G of them.
MAX_PIXELS = 1 << 24


def decode_gif(data: bytes, max_pixels: int = MAX_PIXELS):
    """Yield the frames of a GIF; a GifError says what is wrong with a broken one."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    shared, at = _palette(data, 13, flags)
    if width * height > max_pixels:
        raise GifError(f"a canvas of {width} x {height} is over {max_pixels} pixels")
    canvas = np.zeros((height, width, 3), np.uint8)
    ground = shared[background] if shared is not None and background < len(shared) else np.zeros(3, np.uint8)
    canvas[:] = ground
    delay = disposal = 0
    transparent = None
    clock = index = 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, key = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, key if packed & 1 else None
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise GifError(f"unknown block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        colours = own if own is not None else shared
        if colours is None:
            raise GifError("a frame has no palette")
        if left + w > width or top + h > height or at >= len(data):
            raise GifError("a frame lies outside the canvas")
        size = data[at]
        stream, at = _sub_blocks(data, at + 1)
        indexes = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8)
        if len(indexes) < w * h:
            raise GifError("a frame has too few pixels")
        indexes = indexes.reshape(h, w)
        if flags & 0x40:
            straight = np.empty_like(indexes)
            straight[_rows_of_interlaced(h)] = indexes
            indexes = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        lut = np.zeros((256, 3), np.uint8)
        lut[: len(colours)] = colours
        drawn = lut[indexes]
        if transparent is None:
            area[:] = drawn
        else:
            seen = indexes != transparent
            area[seen] = drawn[seen]
        yield Frame(index, clock, 10 * delay, canvas.copy(), indexes, disposal, transparent)
        if disposal == 2:
            area[:] = ground
        elif disposal == 3:
            canvas = before
        clock += 10 * delay
        index += 1
        delay = disposal = 0
        transparent = None


def encode_gif(frames: list[np.ndarray], palette: np.ndarray, delays_cs: list[int], disposals=None, transparents=None, offsets=None, size=None) -> bytes:
    """A GIF89a of index arrays under one palette of a power of two entries."""
    bits = max(1, (len(palette) - 1).bit_length())
    h, w = size or frames[0].shape
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF0 | (bits - 1), 0, 0), palette.astype(np.uint8).tobytes()]
    for i, frame in enumerate(frames):
        key = transparents[i] if transparents else None
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, (disposals[i] if disposals else 1) << 2 | (key is not None), delays_cs[i], key or 0, 0))
        top, left = offsets[i] if offsets else (0, 0)
        out.append(struct.pack("<BHHHHBB", 0x2C, left, top, frame.shape[1], frame.shape[0], 0, max(2, bits)))
        stream = lzw_encode(frame.tobytes(), max(2, bits))
        out += [bytes([len(stream[a : a + 255])]) + stream[a : a + 255] for a in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def pad_payload(text: bytes) -> bytes:
    return text + b"\0" * (WIDTH - len(text) % WIDTH if len(text) % WIDTH or not text else 0)


def store_bytes(payload: bytes) -> bytes:
    """payload (a positive multiple of 64 bytes) as a grey animation, 64 pixels wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [rows[a : a + FRAME_ROWS] for a in range(0, len(rows), FRAME_ROWS)]
    return encode_gif(frames, GREYS, [DELAY_CS] * len(frames), size=frames[0].shape)


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Share of pixels in each of 4 x 4 x 4 colour cells, as counts."""
    cells = (pixels >> 6).astype(np.intp).reshape(-1, 3)
    return np.bincount(cells[:, 0] << 4 | cells[:, 1] << 2 | cells[:, 2], minlength=64)


def load_bytes(media: bytes) -> tuple[bytes, str]:
    """The payload read back from the decoded frames, and its feature: frames, duration, grey histogram, mean."""
    rows, counts, n, end = [], np.zeros(64, np.int64), 0, 0
    for frame in decode_gif(media):
        rows.append(frame.pixels[: len(frame.samples), :, 0].tobytes())
        counts += histogram(frame.pixels[: len(frame.samples)])
        n, end = n + 1, frame.start_ms + frame.duration_ms
    payload = b"".join(rows)
    greys = counts[[0, 21, 42, 63]]
    mean = float(np.frombuffer(payload, np.uint8).mean())
    return payload, f"frames={n};ms={end};hist={','.join(map(str, greys))};mean={mean:.4f}"


# --- table operators ------------------------------------------------------------------------------------

FRAME_SCHEMA = "media_id long, frame int, start_ms long, duration_ms long, width int, height int, disposal int, pixels binary, histogram array<long>, error string"


def _frames(batches):
    for batch in batches:
        for media_id, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, error = [], None
            try:
                for f in decode_gif(media or b""):
                    rows.append((media_id, f.index, f.start_ms, f.duration_ms, f.pixels.shape[1], f.pixels.shape[0], f.disposal, f.pixels.tobytes(), histogram(f.pixels).tolist(), None))
                    if len(rows) == 16:
                        yield _frame_batch(rows)
                        rows = []
            except (GifError, IndexError, ValueError, OverflowError, MemoryError, struct.error) as e:
                error = str(e) or type(e).__name__
            if error is not None:
                rows.append((media_id, None, None, None, None, None, None, None, None, error))
            if rows:
                yield _frame_batch(rows)


def _frame_batch(rows):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
    names = ["media_id", "frame", "start_ms", "duration_ms", "width", "height", "disposal", "pixels", "histogram", "error"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def gif_frames(media: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """One row for each decoded frame; a broken GIF, or one over MAX_PIXELS, ends in one row with `error` (frames before
    the fault stay)."""
    return arrow_map(media.selectExpr(f"cast(`{id_col}` AS long) AS media_id", f"`{media_col}` AS media"), _frames, FRAME_SCHEMA)


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _round_trip(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = text.encode()
            media = store_bytes(pad_payload(raw))
            payload, feature = load_bytes(media)
            rows.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=[c.split()[0] for c in MEDIA_SCHEMA.split(", ")])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a GIF, read back and described; texts never leave their task."""
    out = arrow_map(ids_and_texts(docs, id_col, text_col), _round_trip, MEDIA_SCHEMA)
    return out.withColumn("doc_id", real_id())


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))


SQL: dict = {}
QUERIES = {"op7_gif_media": op7_gif_media}
