import hashlib
import random
import struct
import zlib

import pytest

from quarry.llm import gif as m

SF = "/root/testdata/sf0.001"


def padded(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def samples(data):
    return b"".join(f["samples"] for f in m.decode(data)["frames"])


def test_query_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = m.query(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        p = padded(texts[r.doc_id])
        want = (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m.encode(p)), hashlib.sha256(m.encode(p)).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want


@pytest.mark.parametrize("rows", [1, 2, 1023, 1024, 1025, 2500])
@pytest.mark.parametrize("kinds", [1, 3, 256])
def test_any_bytes_round_trip(rows, kinds):
    payload = bytes(random.Random(rows * kinds).choices(range(kinds), k=64 * rows))
    assert samples(m.encode(payload)) == payload


def test_edges(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "x" * 300_000, 9), (2, "", 9), (None, "é", 9)]
    stored = m.store_texts(spark.createDataFrame(rows, "doc_id long, text string, media int"))
    got = m.media_columns(stored).collect()
    assert len(got) == 5 and all(r.error is None for r in got)
    assert {r.payload_bytes for r in got if r.n_bytes == 0} == {64}
    bad = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None), (3, bytearray(b"no"))], "doc_id long, media binary")
    assert all(r.error and r.width is None for r in m.media_columns(bad).collect())
    assert m.media_columns(stored.limit(0)).count() == 0


def _frame(samples_, left, top, w, h, disposal=0, delay=0, clear=None, interlaced=False, local=b""):
    packed = disposal << 2 | (clear is not None)
    control = b"\x21\xf9\x04" + struct.pack("<BHB", packed, delay, clear or 0) + b"\0"
    flags = (0x40 if interlaced else 0) | (0x80 | 0 if local else 0)
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + local + b"\x08" + m._blocks(m.pack_codes(m.lzw_codes(bytes(samples_))))


def _gif(*frames, wide=2, high=2, colours=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    return b"GIF89a" + struct.pack("<HHBBB", wide, high, 0x81, 0, 0) + bytes(v for c in colours for v in c) + b"".join(frames) + b"\x3b"


RED, GREEN, BLUE = 3 << 4, 3 << 2, 3


def shown(data):
    return [{k: n for k, n in enumerate(f["histogram"]) if n} for f in m.decode(data)["frames"]]


def test_transparency_and_disposal():
    full = _frame([1, 1, 1, 1], 0, 0, 2, 2)
    assert shown(_gif(full, _frame([2, 0], 0, 0, 2, 1, clear=0), _frame([3], 1, 1, 1, 1))) == [{RED: 4}, {RED: 3, GREEN: 1}, {RED: 2, GREEN: 1, BLUE: 1}]
    assert shown(_gif(full, _frame([2, 2], 0, 0, 2, 1, disposal=2), _frame([3], 1, 1, 1, 1))) == [{RED: 4}, {RED: 2, GREEN: 2}, {RED: 1, BLUE: 1}]
    assert shown(_gif(full, _frame([2, 2], 0, 0, 2, 1, disposal=3), _frame([3], 1, 1, 1, 1))) == [{RED: 4}, {RED: 2, GREEN: 2}, {RED: 3, BLUE: 1}]


def test_local_palette_interlace_and_times():
    local = bytes((0, 0, 255, 0, 255, 0))
    data = _gif(_frame([0, 0, 1, 1], 0, 0, 2, 2, delay=7, local=local), _frame([1, 1, 2, 2, 3, 3, 0, 0], 0, 0, 2, 4, interlaced=True), high=4)
    got = m.decode(data)["frames"]
    assert got[0]["delay_ms"] == 70 and {k for k, n in enumerate(got[0]["histogram"]) if n} == {BLUE, GREEN}
    assert got[1]["samples"] == bytes([1, 1, 3, 3, 2, 2, 0, 0])


def test_small_code_sizes():
    # Two colours, minimum code size 2: clear, 0, 1, 1, end.
    bits = [(4, 3), (0, 3), (1, 3), (1, 3), (5, 3)]
    value = at = 0
    for code, width in bits:
        value |= code << at
        at += width
    assert m.lzw_decode(value.to_bytes(3, "little"), 2, 3) == bytes([0, 1, 1])


def test_frames_have_times(spark):
    stored = m.store_texts(spark.createDataFrame([(1, "x" * (64 * 1024 + 5))], "doc_id long, text string"))
    assert [(r.frame, r.at_ms, r.height) for r in m.frames(m.media_columns(stored)).orderBy("frame").collect()] == [(0, 0, 1024), (1, 40, 1)]


def plain_encode(payload):
    """The textbook coder, a code at a time, for one frame after another."""
    out = b"GIF89a" + struct.pack("<HHBBB", 64, min(len(payload) // 64, 1024), 0xF7, 0, 0) + bytes(v for i in range(256) for v in (i, i, i))
    for first in range(0, len(payload), 64 * 1024):
        data = payload[first : first + 64 * 1024]
        table, width, value, at = {bytes([i]): i for i in range(256)}, 9, 256, 9
        word = b""
        free = 258
        for byte in data:
            longer = word + bytes([byte])
            if longer in table:
                word = longer
                continue
            value |= table[word] << at
            at += width
            if free < 4096:
                table[longer] = free
                width = 9 + (free >= 512) + (free >= 1024) + (free >= 2048)
                free += 1
            else:
                value |= 256 << at
                at += width
                table, width, free = {bytes([i]): i for i in range(256)}, 9, 258
            word = bytes([byte])
        for code in (table[word], 257):
            value |= code << at
            at += width
            if code != 257 and free < 4096:
                width = 9 + (free >= 512) + (free >= 1024) + (free >= 2048)
        stream = value.to_bytes((at + 7) // 8, "little")
        out += b"\x21\xf9\x04\x04\x04\x00\x00\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 64, len(data) // 64, 0) + b"\x08"
        out += b"".join(bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)) + b"\0"
    return out + b"\x3b"


def plain_decode(data):
    """Samples of all frames by a bit-at-a-time reader that knows nothing of the module."""
    at, out = 13 + 768, b""
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        at += 11
        stream = b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        bits, place, width, table, before = int.from_bytes(stream, "little"), 0, 9, [], None
        while True:
            code = bits >> place & ((1 << width) - 1)
            place += width
            if code == 257:
                break
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            word = table[code] if code < len(table) else before + before[:1]
            out += word
            if before is not None and len(table) < 4096:
                table.append(before + word[:1])
            if len(table) in (512, 1024, 2048):
                width = len(table).bit_length()
            before = word
    return out


@pytest.mark.parametrize("rows,kinds", [(1, 256), (3, 1), (40, 4), (200, 256), (1030, 2)])
def test_against_a_plain_coder(rows, kinds):
    payload = bytes(random.Random(rows).choices(range(kinds), k=64 * rows))
    assert plain_decode(m.encode(payload)) == payload
    assert samples(plain_encode(payload)) == payload


def test_query_against_a_plain_decoder(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 3000").select("doc_id", "text")
    for r in m.store_texts(docs).collect():
        text = next(d.text for d in _cached(docs) if d.doc_id == r.doc_id)
        assert plain_decode(bytes(r.media)) == padded(text)


_rows = []


def _cached(docs):
    if not _rows:
        _rows.extend(docs.collect())
    return _rows


def test_files_that_declare_too_much(spark):
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\x01\x00\x00\x3b"
    frame_too_large = _gif(b"\x2c" + struct.pack("<HHHHB", 0, 0, 8192, 8192, 0) + b"\x08\x02\x00\x01\x00")
    many = _gif(*[b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x08\x00"] * 3)
    frame = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate((huge, frame_too_large, many))], "`a.b` long, media binary")
    got = m.media_columns(frame).collect()
    assert [r["a.b"] for r in got] == [0, 1, 2] and all(r.error and r.width is None for r in got)
