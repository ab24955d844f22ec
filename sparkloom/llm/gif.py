"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames and colour histograms.

``decode`` reads any GIF87a or GIF89a file: it unpacks the code streams, applies local or global palettes, interlacing,
transparency and the disposal of the frame before, and gives the canvas of each frame with its delay. ``encode`` writes
8-bit frames. ``store_text`` and ``read_text`` keep bytes in such a file: rows of 64 samples with a grey palette in
which sample value i is colour i, at most ``FRAME_ROWS`` rows a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_texts

WIDTH = 64
FRAME_ROWS = 256
DELAY_MS = 100
#: Codes that a table holds before it is begun anew (fixed value of the format).
TABLE_FULL = 4096


@dataclass
class Frame:
    """A canvas as it is shown: RGB samples (rows, columns, 3), whether each was ever painted, and for how long."""

    rgb: np.ndarray
    painted: np.ndarray
    delay_ms: int


def lzw_pack(samples: bytes) -> bytes:
    """The code stream of 8-bit samples, with the table cleared whenever it is full."""
    codes: list[int] = []
    emit = codes.append
    clears = [0]
    table: dict[int, int] = {}
    find = table.get
    free = 258
    emit(256)
    now = -1
    for b in samples:
        if now < 0:
            now = b
            continue
        key = now << 8 | b
        code = find(key)
        if code is not None:
            now = code
            continue
        emit(now)
        if free < TABLE_FULL:
            table[key] = free
            free += 1
        else:
            clears.append(len(codes))
            emit(256)
            table.clear()
            free = 258
        now = b
    if now >= 0:
        emit(now)
    emit(257)
    return _pack_bits(np.array(codes, np.int64), np.array(clears, np.int64))


def _pack_bits(codes: np.ndarray, clears: np.ndarray) -> bytes:
    """Codes at the width that a reader expects at each place: the n-th code after a clear can name entries to 256 + n."""
    since = np.arange(len(codes)) - clears[np.searchsorted(clears, np.arange(len(codes)), side="right") - 1]
    known = 256 + since  # the highest entry that a reader has when it meets the code
    width = np.clip(np.ceil(np.log2(np.maximum(known, 2) + 1)).astype(np.int64), 9, 12)
    width[clears[1:]] = 12
    width[0] = 9
    at = np.cumsum(width) - width
    out = np.zeros(int(at[-1] + width[-1] + 7) // 8 + 3, np.int64)
    shifted = codes << (at & 7)
    place = at >> 3
    for k in range(3):
        out += np.bincount(place + k, (shifted >> (8 * k)) & 255, len(out)).astype(np.int64)
    return out.astype(np.uint8).tobytes()[: int(at[-1] + width[-1] + 7) // 8]


@lru_cache(maxsize=8)
def _widths(least: int) -> np.ndarray:
    """The width of each code after a clear: before the k-th, the table holds entries up to 2 ** least + k."""
    known = (1 << least) + 2 + np.maximum(np.arange(TABLE_FULL + 1) - 1, 0)
    return np.clip(np.floor(np.log2(known)).astype(np.int64) + 1, least + 1, 12)


def _codes(data: np.ndarray, at: int, widths: np.ndarray) -> np.ndarray:
    """Codes of the given widths from bit ``at`` on, as many as the data has in full."""
    first = at + np.cumsum(widths) - widths
    first = first[first + widths <= 8 * (len(data) - 3)]
    byte = first >> 3
    held = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
    return held >> (first & 7) & ((1 << widths[: len(first)]) - 1)


def _run(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of codes between two clears.

    Entry ``clear + 2 + j`` of the table is the stretch of samples that code j gives and the one after it. So each code that
    names an entry copies earlier samples; where each sample comes from is followed back by doubling, for all at once.
    """
    n = len(codes)
    entry = codes - (clear + 2)
    literal = entry < 0
    if n and (not literal[0] or (entry >= np.arange(n)).any()):
        raise ValueError("a code names no entry")
    source = np.where(literal, np.arange(n), entry)
    extra = np.where(literal, 0, 1)
    while not literal[source].all():  # lengths: one more for each entry on the way to a literal
        extra = extra + np.where(literal[source], 0, extra[source])
        source = source[source]
    length = extra + 1
    start = np.cumsum(length) - length
    total = int(length.sum())
    place = np.arange(total)
    origin = np.where(np.repeat(literal, length), place, place + np.repeat(start[np.where(literal, 0, entry)] - start, length))
    while True:
        back = origin[origin]
        if (back == origin).all():
            break
        origin = back
    out = np.zeros(total, np.uint8)
    out[start[literal]] = codes[literal]
    return out[origin]


def lzw_unpack(stream: bytes, least: int, want: int) -> bytes:
    """The samples of a code stream with ``least`` bits a sample; it ends at its end code or after ``want`` samples."""
    clear, end = 1 << least, (1 << least) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    growing, full = _widths(least), np.full(TABLE_FULL, 12, np.int64)
    parts: list[np.ndarray] = []
    at, size = 0, 0
    while size < want:
        if (_codes(data, at, growing[:1]) == clear).any():
            at += least + 1
            continue
        held: list[np.ndarray] = []
        widths, done = growing, True
        while True:
            codes = _codes(data, at, widths)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop):
                k = int(stop[0])
                held.append(codes[:k])
                at += int(widths[: k + 1].sum())
                done = bool(codes[k] == end)
                break
            held.append(codes)
            at += int(widths[: len(codes)].sum())
            if len(codes) < len(widths):
                break
            widths = full
        run = np.concatenate(held)
        if len(run):
            parts.append(_run(run, clear))
            size += len(parts[-1])
        if done:
            break
    return b"".join(p.tobytes() for p in parts)[:want]


def encode(frames: list[tuple[np.ndarray, int]], palette: bytes, size: tuple[int, int]) -> bytes:
    """A looping GIF89a of 8-bit index frames (rows, columns) with delays in ms on a canvas of (rows, columns)."""
    rows, columns = size
    out = [b"GIF89a", struct.pack("<HHBBB", columns, rows, 0xF7, 0, 0), palette, b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for samples, delay in frames:
        out.append(b"!\xf9\x04" + struct.pack("<BHB", 1 << 2, delay // 10, 0) + b"\0")
        out.append(b"," + struct.pack("<HHHHB", 0, 0, samples.shape[1], samples.shape[0], 0) + b"\x08")
        data = lzw_pack(samples.tobytes())
        out += [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
        out.append(b"\0")
    return b"".join([*out, b";"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.zeros((256, 3), np.uint8)
    colours[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return colours, at + 3 * n


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(a, rows, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> list[Frame]:
    """The frames of a GIF as shown, one after the other."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    columns, rows, flags = struct.unpack_from("<HHB", data, 6)
    if rows * columns > MOST_SAMPLES:
        raise ValueError("a canvas beyond the limit")
    at, shared = 13, np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    rgb, painted = np.zeros((rows, columns, 3), np.uint8), np.zeros((rows, columns), bool)
    disposal, delay, clear = 0, 0, None
    frames: list[Frame] = []
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = _blocks(data, at + 2)
            if kind == 0xF9 and len(body) >= 4:
                bits, hundredths, index = struct.unpack_from("<BHB", body)
                disposal, delay, clear = bits >> 2 & 7, 10 * hundredths, index if bits & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        x, y, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = shared
        if bits & 0x80:
            colours, at = _palette(data, at, bits)
        stream, after = _blocks(data, at + 1)
        if not 1 <= data[at] <= 8 or w * h > MOST_SAMPLES:
            raise ValueError("an image that can't be")
        raw = np.frombuffer(lzw_unpack(stream, data[at], w * h), np.uint8)
        if len(raw) < w * h:
            raise ValueError("a code stream that ends early")
        at = after
        index = raw.reshape(h, w)
        if bits & 0x40:
            index = index[np.argsort(_interlaced(h))]
        before = (rgb.copy(), painted.copy()) if disposal == 3 else None
        index = index[: max(0, rows - y), : max(0, columns - x)]
        area = np.s_[y : y + index.shape[0], x : x + index.shape[1]]
        if clear is None:
            rgb[area], painted[area] = colours[index], True
        else:
            shown = index != clear
            rgb[area][shown], painted[area] = colours[index[shown]], painted[area] | shown
        frames.append(Frame(rgb.copy(), painted.copy(), delay))
        if disposal == 2:
            rgb[area], painted[area] = 0, False
        elif before is not None:
            rgb, painted = before
        disposal, delay, clear = 0, 0, None
    return frames


def histogram(frame: Frame) -> list[int]:
    """Painted samples by the upper two bits of red, green and blue: 64 counts."""
    c = frame.rgb[frame.painted] >> 6
    return np.bincount((c[:, 0] << 4) | (c[:, 1] << 2) | c[:, 2], minlength=64).tolist()


#: Samples of a canvas or an image that are unpacked at most, since a few bytes can ask for gigabytes.
MOST_SAMPLES = 1 << 26

GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def store_text(payload: bytes) -> bytes:
    """A payload of whole rows of 64 bytes as a GIF."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [(rows[i : i + FRAME_ROWS], DELAY_MS) for i in range(0, len(rows), FRAME_ROWS)]
    return encode(frames, GREY, (min(len(rows), FRAME_ROWS), WIDTH))


def heights(media: bytes) -> list[int]:
    """The rows of each frame's own area, from the file's image descriptors."""
    at, found = 13 + (3 * (2 << (media[10] & 7)) if media[10] & 0x80 else 0), []
    while media[at] != 0x3B:
        if media[at] == 0x21:
            at = _blocks(media, at + 2)[1]
            continue
        h, bits = struct.unpack_from("<HB", media, at + 7)
        found.append(h)
        at = _blocks(media, at + 11 + (3 * (2 << (bits & 7)) if bits & 0x80 else 0))[1]
    return found


def read_text(media: bytes) -> tuple[bytes, list[Frame]]:
    """The payload that ``store_text`` keeps, and the frames it is read from."""
    frames = decode(media)
    return b"".join(f.rgb[:h, :, 0].tobytes() for f, h in zip(frames, heights(media))), frames


MEDIA = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)

FRAMES = T.ArrayType(
    T.StructType(
        [
            T.StructField("nth", T.IntegerType()),
            T.StructField("delay_ms", T.IntegerType()),
            T.StructField("rows", T.IntegerType()),
            T.StructField("columns", T.IntegerType()),
            T.StructField("rgb", T.BinaryType()),
            T.StructField("histogram", T.ArrayType(T.LongType())),
        ]
    )
)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Every whole text kept in a GIF and read back from it: the columns of ``MEDIA`` and, if asked for, ``media``.

    The text's UTF-8 bytes, then bytes 0 up to a positive multiple of 64, are the samples. ``payload_sha256`` and
    ``tail_crc32`` (of the last 64 bytes) come from the bytes read back, as does ``feature``: number of frames, their
    time, and how many samples fall in each 16th of the grey scale. A null text counts as empty: one row of zeros.
    Equal texts give equal values, repeated rows repeated rows, an empty table an empty one; other columns are ignored.
    """
    fields = [docs.select(id_col).schema[0], *MEDIA.fields, *([T.StructField("media", T.BinaryType())] if keep_media else [])]

    def make():
        def work(part, texts):
            rows = []
            for t in texts:
                data = t.encode()
                media = store_text(padded(data))
                payload, frames = read_text(media)
                grey = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
                rows.append(
                    (
                        len(data),
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-64:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        f"frames={len(frames)} ms={sum(f.delay_ms for f in frames)} grey={','.join(map(str, grey))}",
                        *([media] if keep_media else []),
                    )
                )
            return dict(zip([f.name for f in fields], [part.column(0), *zip(*rows)]))

        return work

    return map_texts(
        docs.select(F.col(id_col), F.col(text_col).cast("string")), [id_col, text_col], text_col, make, T.StructType(fields)
    )


def gif_frames(media: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row for each frame of each GIF: ``id_col, nth, delay_ms, rows, columns, rgb, histogram`` (64 colour bins).

    Frames are the canvases as shown, after palettes, transparency and disposal. A null, a file that is no whole
    GIF and one whose canvas has more than ``MOST_SAMPLES`` samples give no row; repeated rows give repeated rows and an
    empty table an empty one; other columns are ignored.
    """
    import pyarrow as pa

    schema = T.StructType([media.select(id_col).schema[0], T.StructField("frames", FRAMES)])
    arrow = arrow_schema(schema)

    def frames(data: bytes | None) -> list[dict]:
        try:
            return [
                {
                    "nth": i,
                    "delay_ms": f.delay_ms,
                    "rows": f.rgb.shape[0],
                    "columns": f.rgb.shape[1],
                    "rgb": f.rgb.tobytes(),
                    "histogram": histogram(f),
                }
                for i, f in enumerate(decode(data or b""))
            ]
        except (ValueError, IndexError, struct.error):
            return []

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = pa.array([frames(batch.column(1)[i].as_py())], type=arrow.field(1).type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), found], schema=arrow)

    return media.select(id_col, media_col).mapInArrow(run, schema).select(id_col, F.inline("frames"))
