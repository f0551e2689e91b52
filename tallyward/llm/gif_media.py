"""Media columns: GIF.

Bytes become the pixels of an animated GIF: a grey palette of 256 colours, frames of 192 pixels a row and at most 64
rows, LZW-coded. The reader decodes the LZW code streams, applies palettes, disposal and transparency, and gives timed
frames with colour histograms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

WIDTH, ROWS, DELAY = 192, 64, 10
#: Fixed values of the format: code widths end at 12 bits, so a code table has 4096 entries.
MOST_CODES = 4096


#: The grey palette.
GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of 8 to 12 bits as a bit stream, least bit first."""
    ends = np.cumsum(widths)
    at = ends - widths
    value, byte = codes.astype(np.int64) << (at & 7), at >> 3
    n = int(ends[-1] + 7) >> 3
    parts = (np.bincount(byte + k, weights=value >> 8 * k & 255, minlength=n + 2) for k in range(3))  # their bits are disjoint
    return sum(parts).astype(np.uint8)[:n].tobytes()


def lzw_literal(data: bytes) -> bytes:
    """A code stream of single pixels, with a clear code before each 254 of them: codes never outgrow 9 bits."""
    n, run = len(data), 254
    codes = np.zeros(-(-n // run) * (run + 1), np.int64)
    grid = codes.reshape(-1, run + 1)
    grid[:, 0] = 256
    padded = np.zeros(grid.shape[0] * run, np.uint8)
    padded[:n] = np.frombuffer(data, np.uint8)
    grid[:, 1:] = padded.reshape(-1, run)
    codes = np.append(codes[: n + grid.shape[0]], 257)
    return pack(codes, np.full(len(codes), 9))


def widths_of(n: int, min_bits: int) -> np.ndarray:
    """Bits of the first n codes after a clear code: each but the first adds a word, up to 12 bits."""
    words = (1 << min_bits) + 1 + np.arange(n)
    return np.clip(np.floor(np.log2(np.maximum(words, 1))).astype(np.int64) + 1, min_bits + 1, 12)


WIDTHS = {bits: widths_of(MOST_CODES, bits) for bits in range(1, 12)}


def lzw_compressed(data: bytes) -> bytes:
    """A code stream of the longest known words; the table starts anew when it is full."""
    runs: list[list[int]] = []
    codes, table, free = [256], {}, 258
    code, known = data[0], table.get
    for byte in data[1:]:
        longer = code << 8 | byte
        word = known(longer)
        if word is not None:
            code = word
            continue
        codes.append(code)
        code = byte
        if free < MOST_CODES:
            table[longer] = free
            free += 1
        else:
            runs.append(codes)
            codes, table, free = [256], {}, 258
            known = table.get
    runs.append([*codes, code, 257])
    # a run's clear code still has the width that the table before it had reached
    widths = [np.append(12 if i else 9, WIDTHS[8][: len(run) - 1]) for i, run in enumerate(runs)]
    return pack(np.concatenate([np.array(run) for run in runs]), np.concatenate(widths))


def lzw_decode(stream: bytes, min_bits: int, n_pixels: int) -> bytes:
    """The first n_pixels pixels of a code stream; missing ones are 0. A code beyond the table ends the stream."""
    got = decode_words(stream, min_bits, n_pixels)
    return got[:n_pixels] + bytes(max(0, n_pixels - len(got)))


def followed(to: np.ndarray) -> np.ndarray:
    """Where each index ends if it is led on by `to` until it leads to itself; to leads to itself or to lower ones."""
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def spelled(codes: np.ndarray, clear: int, most: int) -> tuple[np.ndarray, bool]:
    """Pixels of the codes after one clear code, `most` and a word at most, and whether all codes are known.

    Code number i adds the word of code number i with the first pixel of the next: in the output, that word is what
    begins where word i begins. So a later use of it is a copy of an earlier stretch of the output, and a pixel is found
    by following such copies back to a single.
    """
    of = codes - (clear + 2)  # the number of the code that added the word
    single = codes < clear
    bad = np.flatnonzero(~single & (of >= np.arange(len(codes))))
    whole = not len(bad)
    if not whole:
        of, single, codes = of[: bad[0]], single[: bad[0]], codes[: bad[0]]
    # a word is one longer than the one it grew from: count the steps down to a single
    to = np.where(single, np.arange(len(codes)), of)
    length, further = np.where(single, 1, 2), to
    while not single[further].all():
        length = length + length[further] - 1
        further = further[further]
    ends = np.cumsum(length)
    n = int(np.searchsorted(ends, most)) + 1
    length, ends, to, codes = length[:n], ends[:n], to[:n], codes[:n]
    starts = ends - length
    word = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(word))
    source = followed(np.where(single[word], place, starts[to[word]] + place - starts[word]))
    return codes[word[source]].astype(np.uint8), whole


def decode_words(stream: bytes, min_bits: int, n_pixels: int) -> bytes:
    """Words of the code stream, up to its stop code, its first unknown code, or n_pixels pixels and a word.

    Widths depend on how many codes came since the last clear code only, so all codes up to the next one are read at once.
    """
    if not 1 <= min_bits <= 11:
        return b""
    clear, stop = 1 << min_bits, (1 << min_bits) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    data = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    n_bits, at, out, size = len(stream) * 8, 0, [], 0
    while size < n_pixels:
        run, since, mark = [], 0, None
        while mark is None:  # codes number since, since + 1, ... after the last clear code
            widths = WIDTHS[min_bits][since:] if since < MOST_CODES else np.full(MOST_CODES, 12)
            ends = np.cumsum(widths) + at
            n = int(np.searchsorted(ends, n_bits, side="right"))
            if not n:
                break
            starts = ends[:n] - widths[:n]
            codes = data[starts >> 3] >> (starts & 7) & (1 << widths[:n]) - 1
            marks = np.flatnonzero((codes == clear) | (codes == stop))
            if len(marks):
                n = int(marks[0])
                mark, at = int(codes[n]), int(ends[n])
            else:
                since, at = since + n, int(ends[n - 1])
            run.append(codes[:n])
        codes = np.concatenate(run) if run else np.zeros(0, np.int64)
        if len(codes):
            pixels, whole = spelled(codes, clear, n_pixels - size)
            out.append(pixels.tobytes())
            size += len(pixels)
            if not whole:
                break
        if mark != clear:
            break
    return b"".join(out)


def encode(payload: bytes, compress: bool = False) -> bytes:
    """An animated GIF whose pixels, frame by frame, are the payload; its length must be a positive multiple of 192.

    By default its code streams hold single pixels; with `compress` the longest known words, as the query writes them.
    """
    rows = len(payload) // WIDTH
    if not payload or rows * WIDTH != len(payload):
        raise ValueError("the payload must have a positive multiple of 192 bytes")
    two = lambda x: x.to_bytes(2, "little")
    out = [b"GIF89a", two(WIDTH), two(min(rows, ROWS)), bytes((0xF7, 0, 0)), GREY]
    for top in range(0, rows, ROWS):
        part = payload[top * WIDTH : (top + ROWS) * WIDTH]
        coded = lzw_compressed(part) if compress else lzw_literal(part)
        out += [b"\x21\xf9\x04\x04", two(DELAY), b"\0\0", b"\x2c\0\0\0\0", two(WIDTH), two(len(part) // WIDTH), b"\0\x08"]
        out += [bytes((min(255, len(coded) - i),)) + coded[i : i + 255] for i in range(0, len(coded), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3), at + 3 * n


def chunks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while (n := data[at]) > 0:
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def decode(data: bytes, compose: bool = True) -> Iterator[dict]:
    """Timed frames: start_cs and delay_cs, left, top, pixels (rows of palette indices), colours, and the canvas.

    canvas has RGBA after drawing the frame; pixels of the transparent index leave what is below. Disposal 2 clears the
    frame's area before the next frame, disposal 3 restores what was there, others leave it. canvas is None if not
    asked for. Raises ValueError for what isn't a whole GIF.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    try:
        yield from frames(data, compose)
    except IndexError as e:
        raise ValueError("the GIF is cut off") from e


def frames(data: bytes, compose: bool) -> Iterator[dict]:
    word = lambda at: data[at] | data[at + 1] << 8
    width, height, flags = word(6), word(8), data[10]
    common, at = palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8) if compose else None
    control, clock = (0, 0, None), 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = chunks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, body[1] | body[2] << 8, body[3] if body[0] & 1 else None)
            at = end
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, own = word(at + 1), word(at + 3), word(at + 5), word(at + 7), data[at + 9]
        colours, at = palette(data, at + 10, own)
        colours = common if colours is None else colours
        coded, end = chunks(data, at + 1)
        pixels = np.frombuffer(lzw_decode(coded, data[at], w * h), np.uint8).reshape(h, w)
        at = end
        if own & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        disposal, delay, clear = control
        frame = {"start_cs": clock, "delay_cs": delay, "left": left, "top": top, "pixels": pixels, "colours": colours, "transparent": clear, "canvas": None}
        if compose and colours is not None:
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            seen = pixels[: area.shape[0], : area.shape[1]]
            shown = np.full((256, 4), 255, np.uint8)
            shown[:, :3] = colours[np.minimum(np.arange(256), len(colours) - 1)]
            if clear is None:
                area[:] = shown[seen]
            else:
                drawn = seen != clear
                area[drawn] = shown[seen[drawn]]
            frame["canvas"] = canvas.copy()
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
        yield frame
        clock += delay
        control = (0, 0, None)


def histogram(frame: dict, bins: int = 8) -> np.ndarray:
    """Counts of the frame's visible pixels by their red, green and blue, in `bins` equal steps each: 3 x bins."""
    counts = np.bincount(frame["pixels"].ravel(), minlength=256)
    if frame["transparent"] is not None:
        counts[frame["transparent"]] = 0
    colours = np.zeros((256, 3), np.uint8)
    if frame["colours"] is not None:
        colours[: len(frame["colours"])] = frame["colours"]
    return np.stack([np.bincount(colours[:, c].astype(np.int64) * bins // 256, weights=counts, minlength=bins) for c in range(3)]).astype(np.int64)


FRAMES = "start_cs bigint, delay_cs bigint, left bigint, top bigint, width bigint, height bigint, red array<bigint>, green array<bigint>, blue array<bigint>"
FRAME_SCHEMA = pa.schema([(c.split()[0], pa.list_(pa.int64()) if "array" in c else pa.int64()) for c in FRAMES.split(", ")])


def timed(frame: dict) -> tuple:
    """A frame's times, place and colour histograms, in the order of FRAMES."""
    return (frame["start_cs"], frame["delay_cs"], frame["left"], frame["top"], frame["pixels"].shape[1], frame["pixels"].shape[0], *histogram(frame).tolist())


def frame_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """key and one row per frame with its times, place and colour histograms; null or broken media give no rows."""
    kind = media.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for row, data in enumerate(batch.column(1)):
                try:
                    found = [timed(f) for f in (decode(data.as_py(), compose=False) if data.is_valid else ())]
                except ValueError:
                    continue
                of += [row] * len(found)
                out += found
            frames = pa.Table.from_pylist([dict(zip(names, f, strict=True)) for f in out], schema=FRAME_SCHEMA).combine_chunks().to_batches()
            if frames:
                yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), *frames[0].columns], names=[key, *names])

    return media.select(key, column).mapInArrow(rows, f"{key} {kind}, {FRAMES}")


def to_media(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and its payload (padded by spaces to a positive multiple of 192) as a GIF of dictionary words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), encode(raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), compress=True)


STORED = f"doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, frames array<struct<{', '.join(c.replace(' ', ': ', 1) for c in FRAMES.split(', '))}, pixels: binary>>"
NAMES = [*(c.split()[0] for c in FRAMES.split(", ")), "pixels"]
#: Text of one written batch: frames of a batch are in memory together.
BATCH_BYTES = 1 << 23


def media_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Store each text as a GIF and decode that: one row per document with its timed frames, in STORED's columns.

    A frame's pixels are the red of what the canvas shows in its area once it is drawn, row by row.
    """
    lists, kind = pa.list_(pa.int64()), pa.int64()
    frame_type = pa.struct([*((n, lists if n in ("red", "green", "blue") else kind) for n in NAMES[:-1]), (NAMES[-1], pa.binary())])
    fields = pa.schema([("doc_id", kind), ("n_bytes", kind), ("media_bytes", kind), ("media_sha256", pa.string()), ("frames", pa.list_(frame_type))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    for batch in batches:
        out, held = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, media = to_media(text.as_py())
            rows = []
            for f in decode(media):
                (h, w), top, left = f["pixels"].shape, f["top"], f["left"]
                rows.append(dict(zip(NAMES, (*timed(f), f["canvas"][top : top + h, left : left + w, 0].tobytes()), strict=True)))
            out.append((doc_id, n, len(media), hashlib.sha256(media).hexdigest(), rows))
            held += n
            if held >= BATCH_BYTES:
                yield batch_of(out)
                out, held = [], 0
        if out:
            yield batch_of(out)


def digests(media: DataFrame) -> DataFrame:
    """Payload digests and the feature of each stored document, from its frames."""
    payload = F.unhex(F.array_join(F.transform("frames", lambda f: F.hex(f["pixels"])), ""))
    summed = lambda take: F.aggregate("frames", F.lit(0).cast("bigint"), lambda a, f: a + take(f))
    shades = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.aggregate("frames", F.lit(0).cast("bigint"), lambda a, f: a + F.get(f["red"], b)).cast("string"))
    feature = F.concat(F.lit("frames="), F.size("frames").cast("string"), F.lit(";cs="), summed(lambda f: f["delay_cs"]).cast("string"), F.lit(";grey="), F.array_join(shades, ","))
    described = media.withColumn("payload", payload)
    return described.select("doc_id", "n_bytes", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


def op7_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; null text counts as empty. Decoded frames are stored, and the digests are read from them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return digests(stored(docs.mapInArrow(media_frames, STORED), "gif-frames"))
