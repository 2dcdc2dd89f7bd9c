"""Token ids as length-delimited binary records, with a separate offset index.

A file is a run of records in ascending doc_id order, and files follow each other in the order of
their part number. A record, all integers little-endian:

    8 bytes   length of the payload
    4 bytes   masked checksum of those 8 bytes
    payload   8 bytes doc_id, 1 byte flags (bit 0: the id is null), 1 byte width (2 or 4), token ids
    4 bytes   masked checksum of the payload
    1 byte    newline

Checksums are CRC-32 (the zlib polynomial), masked by rotating right by 15 bits and adding a
constant, so that checksums stored inside checksummed data do no harm. Spark's text writer puts
the newline there; using it means that files are committed by Spark's protocol on whatever storage
the shared folder is on, and that a lost executor's tasks are simply run again.

The index has one row per record: file, part, record, offset, length, doc_id, n_tokens, start of
the document inside its part, checksum. A shuffled reader seeks by it (``read_records``).

Defined cases: a null text is empty and has the end id only; a null doc_id comes first; rows of
equal doc_id are ordered by a hash of their text, then the text; an empty table gives an empty
index; other columns are ignored, whatever their names. Documents are tokenized whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, repeat
from math import ceil
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm._common import fresh_path, input_bytes, keeps, lean, only, small_batches, table

#: Fixed values of the record format.
MASK_ADD = 0xA282EAD8
HEAD = struct.Struct("<QI")
BODY = struct.Struct("<qBB")
TAIL = struct.Struct("<I")

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Encoded pieces that a worker remembers, about 200 bytes each. Later ones, which are rarer, it
#: encodes for their batch; if most of a batch is new to it, it starts anew.
REMEMBERED = 600_000
#: Pieces that the library encodes at a time, and characters and rows that a worker cuts at a time; one row is the least.
LEARNED, CHARACTERS, ROWS = 4096, 1 << 20, 200

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Cuts a text only where the byte-level pre-tokenizer must cut too: before white space that follows
#: a non-space, after a lone line break before a letter, and between a letter and plain punctuation.
_PIECE = re.compile(rf"\n(?=[{_LETTER}])| ?[{_LETTER}]+(?=[ \t\n\r.,!?;:#$%&*|()]|\Z)|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: A piece that the pre-tokenizer leaves whole, and the characters by which it names the bytes: printable ones themselves, the others in turn from 256 on.
_WORD = re.compile(rf" ?[{_LETTER}]+")
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_NAMES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: White space that is not among the four above: such texts are encoded in one go. The bytes that
#: can begin one are looked for first.
_RARE_SPACE = re.compile(r"[^\S \t\n\r]|[\x1c-\x1f\x85\u200b\ufeff]")
_RARE_BYTES = (b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1", b"\xe2", b"\xe3", b"\xef")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


class Encoder:
    """Whole-text encoding by the tokenizers library, with each distinct piece encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The cut rule is that of the byte-level pre-tokenizer; with any other, texts are encoded whole.
        parts = json.loads(self.tokenizer.to_str())
        kind = parts["pre_tokenizer"] or {}
        self.cuts = (
            (kind.get("type"), kind.get("add_prefix_space"), kind.get("use_regex")) == ("ByteLevel", False, True)
            and parts["normalizer"] is None and parts["post_processor"] is None and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout")
        )
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # ``known`` takes its place
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Plain words by the library's model alone, as nothing else of it changes them; others a few thousand at a time: what the library returns for a piece takes many times the piece."""
        out, others = {}, []
        for piece in fresh:
            if _WORD.fullmatch(piece):
                named = piece.encode().decode("latin-1").translate(_BYTE_NAMES)
                out[piece] = array(self.code, [t.id for t in self.model.tokenize(named)]).tobytes()
            else:
                others.append(piece)
        for k in range(0, len(others), LEARNED):
            own = others[k : k + LEARNED]
            coded = self.tokenizer.encode_batch_fast(own, add_special_tokens=False)
            out.update((piece, array(self.code, got.ids).tobytes()) for piece, got in zip(own, coded, strict=True))
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        known = self.known
        cut: list[list[str] | None] = []
        for t in texts:
            data = t.encode("utf-8", "surrogatepass") if self.cuts else b""
            rare = any(b in data for b in _RARE_BYTES) and _RARE_SPACE.search(t)
            cut.append(None if rare or not self.cuts or any(s in t for s in self.special) else _PIECE.findall(t))
        found = [None if pieces is None else list(map(known.get, pieces)) for pieces in cut]
        # The places of pieces that are not known, of the texts that have any.
        lacking = {k: list(compress(range(len(got)), map(is_, got, repeat(None)))) for k, got in enumerate(found) if got is not None and None in got}
        fresh = {cut[k][i] for k, places in lacking.items() for i in places}
        learned = self._learn(list(fresh))
        for k, places in lacking.items():
            for i in places:
                found[k][i] = learned[cut[k][i]]
        if len(known) + len(learned) <= REMEMBERED:
            known.update(learned)
        elif 2 * len(fresh) > sum(len(pieces) for pieces in cut if pieces):
            known.clear()
        return [self._whole(t) if got is None else b"".join(got) for t, got in zip(texts, found, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
        keeps("token-records", _encoders.clear)
    return _encoders[path]


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = BODY.pack(doc_id or 0, doc_id is None, width) + ids
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """From and to of rows that are cut at a time."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and (k - start >= ROWS or size + len(t or "") > CHARACTERS):
            yield start, k
            start, size = k, 0
        size += len(t or "")
    if texts:
        yield start, len(texts)


def _encode(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("token-records")
        enc = encoder(path)
        end, width = array(enc.code, [end_id]).tobytes(), array(enc.code).itemsize
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, stop in _runs(texts):
                coded = enc.batch([t or "" for t in texts[k:stop]])
                frames = [frame(i, c + end, width) for i, c in zip(ids[k:stop], coded, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    return run


def write_records(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID, part_bytes: int = 12 << 20) -> None:
    """Tokenize ``docs`` (doc_id, text) and write record files under ``path``.

    ``part_bytes``: input bytes for each file, so the number of files grows with the input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, ceil(input_bytes(docs) / part_bytes))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    framed = ranged.mapInArrow(lean(_encode(tokenizer_path, end_id)), "frame binary")
    framed.select(F.col("frame").cast("string")).write.option("lineSep", "\n").text(path)


def parse(content: memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """offset, length, doc_id and token ids of each record; a wrong checksum is an error."""
    at = 0
    while at < len(content):
        head = bytes(content[at : at + 8])
        length, check = HEAD.unpack(content[at : at + 12])
        if masked(head) != check:
            raise ValueError(f"checksum of the length at byte {at} is wrong")
        payload = content[at + 12 : at + 12 + length]
        if masked(payload) != TAIL.unpack(content[at + 12 + length : at + 16 + length])[0]:
            raise ValueError(f"checksum of the record at byte {at} is wrong")
        doc_id, flags, width = BODY.unpack(payload[: BODY.size])
        ids = np.frombuffer(payload[BODY.size :], "<u2" if width == 2 else "<u4")
        yield at, length, None if flags & 1 else doc_id, ids
        at += length + 17


INDEX = "file string, part long, record long, offset long, length long, doc_id long, n_tokens long, start_in_part long, ids_crc32 long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in INDEX.split(", ")]
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = int(re.search(r"part-(\d+)", name)[1])
            rows, start = [], 0
            for k, (at, length, doc_id, ids) in enumerate(parse(memoryview(content.as_buffer()))):
                rows.append((name, part, k, at, length, doc_id, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            if rows:
                columns = [pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names)


def build_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Read every record file back, check it, and write the offset index beside it."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files.mapInArrow(lean(_index), INDEX).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        content, offsets, place = (batch.column(i) for i in range(3))
        got = []
        for c, o in zip(content, offsets.to_pylist(), strict=True):
            whole = memoryview(c.as_buffer())
            length = int.from_bytes(whole[o : o + 8], "little")
            got.append(next(parse(whole[o : o + length + 17])))
        yield pa.RecordBatch.from_arrays(
            [place, pa.array([g[2] for g in got], pa.int64()), pa.array([g[3].astype("i8") for g in got], pa.list_(pa.int64()))], ["place", "doc_id", "ids"]
        )


def read_records(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """Shuffled read: place, doc_id, ids for the index rows given, ``place`` a seeded random order.

    Only ranges named by the index are parsed; one file's ranges are cut from it in one task.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    wanted = index.select("file", "offset", F.xxhash64(F.lit(seed), "part", "record").alias("place"))
    cut = files.join(wanted, "file").select("content", "offset", "place")
    return cut.mapInArrow(lean(_pick), "place long, doc_id long, ids array<long>").orderBy("place")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all documents before each, over all files."""
    per = index.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(per.select("part", before.alias("before")), "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_records(docs, f"{path}/records")
    index = build_index(spark, f"{path}/records", f"{path}/index")
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "offset", "length")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark, table(spark, sf_dir, "documents"))
