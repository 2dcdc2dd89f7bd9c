import random
import zlib
from array import array

import pytest

from quarry.llm import token_records as m
from quarry.llm._common import fresh_path
from tests.parity import SF

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path(m.VOCABULARY))


def want(tokenizer, docs):
    start, out = 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, m.END_ID]
        out.append((doc, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    return out


def rows(frame):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in frame.collect()), key=lambda r: r[1])


def test_query_against_the_library(spark, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(m.query(spark, SF)) == want(tokenizer, docs)


def test_edges(spark, tokenizer):
    docs = [(5, "late"), (1, None), (2, ""), (None, "no id"), (3, "ab " * 50_000), (4, "<|endoftext|> x  y"), (9, "tail\n\n  end ")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, frame int")
    assert rows(m.digest(spark, frame)) == want(tokenizer, docs)
    assert m.digest(spark, frame.limit(0)).count() == 0


def test_repeated_rows_keep_their_places(spark, tokenizer):
    docs = [(1, "same"), (1, "same"), (2, "x")]
    assert rows(m.digest(spark, spark.createDataFrame(docs, "doc_id long, text string"))) == want(tokenizer, docs)


def test_pieces_equal_whole_texts(tokenizer):
    random.seed(1)
    letters = [*"ab'sé \n\t.,!?;#$%&*|()-_1９ßñ\r\x0b\x1c", "'s", "'ll", "  ", "\n\n", "don't", "<|endoftext|>", "…", "漢"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(5000)]
    coded = m.encoder(None).batch(texts)
    assert all(c == array("H", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for c, t in zip(coded, texts, strict=True))


def test_a_full_memory_still_encodes(tokenizer, monkeypatch):
    monkeypatch.setattr(m, "REMEMBERED", 3)
    import public_tokenizers

    enc = m.Encoder(public_tokenizers.path(m.VOCABULARY))
    texts = ["one two three four five", "six seven eight one two"]
    for _ in range(3):
        assert enc.batch(texts) == [array("H", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_frames_round_trip_and_are_checked():
    data = m.frame(7, array("H", [1, 2]).tobytes(), 2) + b"\n" + m.frame(None, b"", 4) + b"\n"
    assert [(d, ids.tolist()) for _, _, d, ids in m.parse(memoryview(data))] == [(7, [1, 2]), (None, [])]
    for k in (0, 9, 15):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            list(m.parse(memoryview(bytes(broken))))


def test_shuffled_read_by_index(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    path = fresh_path(spark, "test")
    m.write_records(docs, f"{path}/records")
    index = m.build_index(spark, f"{path}/records", f"{path}/index")
    got = m.read_records(spark, f"{path}/records", index.filter("doc_id < 5"), 3).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4] and all(r.ids[-1] == m.END_ID for r in got)


def test_few_pieces_are_encoded_at_a_time():
    enc = m.encoder(None)
    asked = []

    class Watched:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, pieces, **options):
            asked.append(len(pieces))
            return self.inner.encode_batch_fast(pieces, **options)

    other = object.__new__(type(enc))
    other.__dict__ = enc.__dict__ | {"tokenizer": Watched(enc.tokenizer), "known": {}}
    text = " ".join(f"zq{k}x" for k in range(9000))
    assert other.batch([text]) == [enc._whole(text)] and max(asked) <= 4096
    texts = ["a" * 700_000, None, "b" * 700_000, "c"] + [""] * 500
    runs = list(m._runs(texts))
    assert runs[:2] == [(0, 2), (2, 202)] and runs[-1][1] == len(texts)


def test_plain_words_are_encoded_by_the_model_alone(tokenizer, monkeypatch):
    import public_tokenizers

    random.seed(2)
    enc, asked = m.Encoder(public_tokenizers.path(m.VOCABULARY)), []

    class Watched:
        def encode_batch_fast(self, pieces, **options):
            asked.extend(pieces)
            return tokenizer.encode_batch_fast(pieces, **options)

    monkeypatch.setattr(enc, "tokenizer", Watched())
    letters = [*"abcdefghijklmnopqrstuvwxyzABCXYZ", *(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]
    texts = [" ".join("".join(random.choices(letters, k=random.randint(1, 14))) for _ in range(300)) for _ in range(20)]
    texts.append("a1 b-c it's\n\nend.")
    want = [array("H", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert enc.batch(texts) == want
    assert sorted(asked) == sorted({p for p in m._PIECE.findall(texts[-1]) if not p.strip(" ").isalpha()})
