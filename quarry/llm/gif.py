"""GIF media columns: writing bytes as GIF samples, and decoding GIF to timed frames.

``decode`` reads any GIF: it decodes the LZW code streams, undoes interlacing, applies global and
local palettes, transparency and the disposal of the frame before, and gives each frame's samples,
delay and the histogram of the canvas as shown, 64 bins of two bits a channel.

``encode`` stores bytes as the samples of grey 8-bit frames 64 wide and at most 1024 high, LZW
coded, so that a text's bytes come back exactly as the frames' samples in order.

Defined cases: a null text is empty, and the padding makes one row of zeros of it; bytes that are
no readable GIF, that declare more than ``MOST_PIXELS`` and 256 pixels for each byte of the file
(what ``encode`` writes stays below 200), or whose code stream is too short to fill its frame, give null fields and the reason in ``error``, before any memory is
taken for the pixels they declare; every row is judged by itself, so
repeated rows and equal ids are no matter; an empty table gives an empty result; other columns are
ignored or kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm._common import lean, numbered, small_batches, table, written

WIDTH, MOST_ROWS, PAD = 64, 1024, 64
#: Pixels that a file of any size may declare, canvas and frames together, about 320 MB, and those for each of its bytes.
MOST_PIXELS, MOST_RATIO = 1 << 26, 256
#: Samples that one byte of a code stream can stand for at most: two codes of 4096 for three bytes.
MOST_PER_BYTE = 4096
DELAY_CS = 4
BINS = 64

_TABLE = 4096
#: Places of a clear's codes: width and bit offset of each, until the table is full and a clear must come.
_WIDTHS8 = np.minimum(12, 9 + np.searchsorted([256, 768, 1792], np.arange(1, 3841), side="right"))
_GREY = bytes(v for i in range(256) for v in (i, i, i))


def lzw_codes(data: bytes) -> list[list[int]]:
    """Runs of codes, each begun by a clear; the last ends with the end code.

    The table is a tree: a node maps the next byte to the longer entry's node, and -1 to its code.
    """
    runs, run, free = [], [256], 258
    roots = [{-1: i} for i in range(256)]
    if data:
        node = roots[data[0]]
        for byte in data[1:]:
            longer = node.get(byte)
            if longer is not None:
                node = longer
                continue
            run.append(node[-1])
            if free < _TABLE:
                node[byte] = {-1: free}
                free += 1
                node = roots[byte]
            else:
                runs.append(run)
                run, free = [256], 258
                roots = [{-1: i} for i in range(256)]
                node = roots[byte]
        run.append(node[-1])
    run.append(257)
    runs.append(run)
    return runs


def pack_codes(runs: list[list[int]]) -> bytes:
    """Least bit first. A run's clear has the width that the run before has come to."""
    codes = np.array([c for r in runs for c in r], dtype="i8")
    widths = np.concatenate([np.concatenate(([9 if k == 0 else _WIDTHS8[min(len(runs[k - 1]) - 1, 3839)]], _WIDTHS8[: len(r) - 1])) for k, r in enumerate(runs)])
    ends = np.cumsum(widths)
    at = ends - widths
    spread = codes << (at & 7)
    first, size = at >> 3, int(ends[-1] + 7) >> 3
    out = sum(np.bincount(first + k, weights=(spread >> (8 * k)) & 255, minlength=size + 2) for k in range(3))
    return out[:size].astype("u1").tobytes()


def _schedule(least: int) -> np.ndarray:
    """Width of the m-th code after a clear, m from 1, for a minimum code size."""
    if least == 8:
        return _WIDTHS8
    clear = 1 << least
    free = clear + 2 + np.maximum(0, np.arange(1, _TABLE - clear + 1) - 2)
    return np.minimum(12, np.maximum(least + 1, np.floor(np.log2(np.maximum(free, 1))).astype("i8") + 1))


def lzw_decode(data: bytes, least: int, need: int) -> bytes:
    """Samples of a code stream. A full table stays as it is until a clear."""
    clear, end = 1 << least, (1 << least) + 1
    bits = np.frombuffer(data + b"\0\0\0", "u1").astype("i8")
    total = len(data) * 8
    schedule = _schedule(least)
    starts = np.concatenate(([0], np.cumsum(schedule)))[:-1]
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made, at = 0, 0
    words, prev = list(base), None
    place = 0  # codes read since the last clear

    def read(position: int, widths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        where = position + offsets
        fits = int(np.searchsorted(where + widths, total, side="right"))
        where, widths = where[:fits], widths[:fits]
        byte = where >> 3
        return ((bits[byte] | bits[byte + 1] << 8 | bits[byte + 2] << 16) >> (where & 7)) & ((1 << widths) - 1)

    twelve = np.full(4096, 12)
    twelve_at = np.arange(4096) * 12
    while made < need:
        if place < len(schedule):
            widths, offsets = schedule[place:], starts[place:] - starts[place]
        else:
            widths, offsets = twelve, twelve_at
        codes = read(at, widths, offsets)
        if not len(codes):
            break
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        todo = codes[:n].tolist()
        if prev is None and todo:
            if todo[0] >= clear:
                raise ValueError("a code stream starts with an unknown code")
            prev = words[todo[0]]
            out.append(prev)
            todo = todo[1:]
        room = _TABLE - len(words)
        for code in todo[:room]:
            try:
                word = words[code]
            except IndexError:
                if code != len(words):
                    raise ValueError("a code is past the table") from None
                word = prev + prev[:1]
            words.append(prev + word[:1])
            out.append(word)
            prev = word
        for code in todo[room:]:
            prev = words[code]
            out.append(prev)
        place += n
        at += int(offsets[n - 1] + widths[n - 1]) if n else 0
        if len(stops):
            at += int(widths[n])
            if codes[n] == end:
                break
            words, prev, place = list(base), None, 0
        else:
            made = sum(map(len, out))
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes) -> bytes:
    """``payload``: a positive multiple of 64 bytes."""
    rows = len(payload) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MOST_ROWS), 0xF7, 0, 0), _GREY]
    for first in range(0, rows, MOST_ROWS):
        high = min(MOST_ROWS, rows - first)
        samples = payload[first * WIDTH : (first + high) * WIDTH]
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, high, 0) + b"\x08")
        parts.append(_blocks(pack_codes(lzw_codes(samples))))
    parts.append(b"\x3b")
    return b"".join(parts)


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    pieces = []
    while True:
        size = data[at]
        if not size:
            return b"".join(pieces), at + 1
        if at + 1 + size >= len(data):
            raise ValueError("a block is cut off")
        pieces.append(data[at + 1 : at + 1 + size])
        at += 1 + size


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.full((256, 4), 255, "u1")
    colours[n:, :3] = 0
    colours[:n, :3] = np.frombuffer(data[at : at + 3 * n], "u1").reshape(n, 3)
    return colours, at + 3 * n


def histogram(canvas: np.ndarray) -> list[int]:
    """Pixels of each of 64 colours, two bits a channel; transparent pixels are not counted."""
    two = (canvas[..., 0] >> 6 << 4) | (canvas[..., 1] >> 6 << 2) | (canvas[..., 2] >> 6)
    seen = canvas[..., 3] > 0
    return np.bincount(two.ravel() if seen.all() else two[seen], minlength=BINS).tolist()


def decode(data: bytes) -> dict:
    """width, height, frames: each delay_ms, disposal, left, top, width, height, samples, histogram."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    wide, high, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    pixels, most = wide * high, MOST_PIXELS + MOST_RATIO * len(data)
    if pixels > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((high, wide, 4), "u1")
    control, frames = (0, 0, None), []
    while True:
        mark = data[at] if at < len(data) else 0x3B
        if mark == 0x3B:
            break
        if mark == 0x21:
            body, end = _joined(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                control = (packed >> 2 & 7, delay * 10, index if packed & 1 else None)
            at = end
            continue
        if mark != 0x2C:
            raise ValueError(f"unknown block at byte {at}")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        colours = common
        if flags & 0x80:
            colours, at = _palette(data, at, flags)
        if colours is None:
            raise ValueError("a frame has no palette")
        least = data[at]
        if not 2 <= least <= 8:
            raise ValueError("the code size is out of range")
        stream, at = _joined(data, at + 1)
        pixels += w * h
        if w * h > MOST_PIXELS or pixels > most:
            raise ValueError("the frames are too large")
        if w * h > MOST_PER_BYTE * len(stream):
            raise ValueError("a code stream is too short for its frame")
        samples = lzw_decode(stream, least, w * h)[: w * h]
        index = np.zeros(w * h, "u1")
        index[: len(samples)] = np.frombuffer(samples, "u1")
        index = index.reshape(h, w)
        if flags & 0x40:
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        disposal, delay, clear = control
        before = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        shown = index[: region.shape[0], : region.shape[1]]
        opaque = np.ones((1, 1), bool) if clear is None else shown != clear
        np.copyto(region, colours[shown], where=opaque[..., None])
        frames.append(
            {"delay_ms": delay, "disposal": disposal, "left": left, "top": top, "width": w, "height": h, "samples": index.tobytes(), "histogram": histogram(canvas)}
        )
        if disposal == 2:
            region[...] = 0
        elif disposal == 3:
            canvas = before
        control = (0, 0, None)
    return {"width": wide, "height": high, "frames": frames}


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            part = batch.slice(k, 100)
            sizes, media = [], []
            for text in part.column(1):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                media.append(encode(raw + bytes(-len(raw) % PAD or (0 if raw else PAD))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


_FRAME = pa.struct([("delay_ms", pa.int32()), ("disposal", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
_FRAME_SQL = "struct<delay_ms:int,disposal:int,left:int,top:int,width:int,height:int,histogram:array<bigint>>"
DECODED = f"width int, height int, frames array<{_FRAME_SQL}>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), pa.int32(), pa.list_(_FRAME), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for cell in batch.column(batch.num_columns - 1):
            data = cell.as_py()
            stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
            try:
                if data is None:
                    raise ValueError("no bytes")
                got = decode(data)
                samples = b"".join(f.pop("samples") for f in got["frames"])
                rows.append((got["width"], got["height"], got["frames"], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]), *stored, None))
            except (ValueError, IndexError, struct.error) as why:
                rows.append((None,) * 6 + (*stored, str(why)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        kept = [batch.column(k) for k in range(batch.num_columns - 1)]
        names = [*batch.schema.names[:-1], "width", "height", "frames", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "error"]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (doc_id, text) as a GIF."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(_encode), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_columns(media: DataFrame) -> DataFrame:
    """The columns of ``media`` but its last, which holds GIF bytes, and what decoding gives."""
    small_batches(media.sparkSession)
    plain = numbered(media)
    names = media.columns[:-1]
    added = StructType.fromDDL(DECODED)
    return plain.mapInArrow(lean(_decode), StructType([*plain.schema[:-1], *added])).toDF(*names, *added.names)


def frames(decoded: DataFrame) -> DataFrame:
    """One row a frame: when it is shown, for how long, and the colours then on the canvas."""
    each = decoded.select("doc_id", F.posexplode("frames").alias("frame", "f"), "frames")
    shown_at = F.aggregate(F.slice("frames", F.lit(1), F.col("frame")), F.lit(0).cast("long"), lambda t, f: t + f["delay_ms"])
    return each.select("doc_id", "frame", shown_at.alias("at_ms"), "f.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(store_texts(table(spark, sf_dir, "documents")), "gif")
    read = media_columns(stored)
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), BINS), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("size="), F.col("width"), F.lit("x"), F.col("height")),
        F.concat(F.lit("frames="), F.size("frames")),
        F.concat(F.lit("ms="), F.aggregate("frames", F.lit(0), lambda t, f: t + f["delay_ms"])),
        F.concat(F.lit("hist="), F.array_join(F.transform(F.filter(F.arrays_zip(F.sequence(F.lit(0), F.lit(BINS - 1)).alias("bin"), total.alias("n")), lambda x: x["n"] > 0), lambda x: F.concat(x["bin"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")),
    )
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.size("frames").alias("n_frames"))
