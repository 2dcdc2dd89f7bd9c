import hashlib
import random

import numpy as np
import pyarrow as pa

from quarry.llm import repeats as m

SF = "/root/testdata/sf0.001"


def brute(rows):
    seen = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 49):
            if d is not None and seen[b[p : p + 50]] < d:
                cover[p : p + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1]))
        out.append((d, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(m.query(spark, SF)) == brute(docs)


def test_hard_texts(spark):
    random.seed(3)
    base = ["".join(random.choices("ab ", k=300)) for _ in range(5)] + ["x" * 200, "ab" * 90, "é" * 80]
    rows = []
    for i in range(150):
        pieces = []
        for _ in range(random.randint(0, 4)):
            a = random.randint(0, 150)
            pieces.append(random.choice(base)[a : a + random.randint(0, 200)])
        rows.append((i, "".join(pieces)))
    rows += [(None, base[0]), (500, None), (501, ""), (502, "z" * 49), (503, "z" * 50), (503, "z" * 50), (504, "z" * 50), (7, base[1])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kind int")
    assert rows_of(m.repeated(frame)) == brute(rows)


def test_empty_table_and_very_long_text(spark):
    frame = spark.createDataFrame([(1, "word " * 400_000), (2, "word " * 20)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in m.repeated(frame).collect()} == {1: 0, 2: 100}
    assert m.repeated(frame.limit(0)).count() == 0


def test_each_window_is_in_one_phrase():
    texts = [b"the quick brown fox jumps over the lazy dog and runs away from here", b"short", b"a" * 120]
    _, _, owner, at, count, data = m.parse(texts, 7)
    starts = [p for a, c in zip(at, count, strict=True) for p in range(a, a + c)]
    want, first = [], 0
    for t in texts:
        want += range(first, first + max(0, len(t) - 49))
        first += len(t)
    assert starts == want


def test_suffix_order():
    data = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=200)), "u1")
    places = np.arange(150)
    order, new = m.suffix_order(data, places)
    windows = [data[p : p + 50].tobytes() for p in order]
    assert windows == sorted(windows)
    assert new.tolist() == [i == 0 or windows[i] != windows[i - 1] for i in range(len(windows))]


def hot_rows(n, rng, alphabet="abcdefghijklmnopqrstuvwxyz "):
    """Documents of their own amid which one string stands that all share, and some near ones."""
    shared = "the one shared string of low hash stands here in all"
    body = lambda k: "".join(rng.choices(alphabet, k=k))
    rows = [(d, body(rng.randint(0, 90)) + shared[: rng.choice([25, 30, 52])] + body(rng.randint(0, 90))) for d in range(n)]
    return rows + [(n + d, "x" + rows[rng.randrange(n)][1][rng.randint(0, 20) :]) for d in range(n // 4)] + [(None, rows[0][1]), (3, rows[5][1]), (2, "a" * 400 + shared)]


def test_hot_triggers_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    rows = hot_rows(120, rng) + [(1000 + k, "ab" * rng.randint(20, 120)) for k in range(30)] + [(2000 + k, "z" * rng.randint(40, 300)) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for hot in (0, 1, 3, 128):
        monkeypatch.setattr(m, "HOT", hot)
        assert rows_of(m.repeated(frame)) == want, hot


def test_a_hot_trigger_is_dealt_over_buckets(monkeypatch):
    """Of a trigger that every document has, a part sends a mark instead of its phrases, and its windows go everywhere."""
    rng = random.Random(5)
    texts = [t.encode() for _, t in hot_rows(2000, rng)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array(range(len(texts)), pa.int64()), pa.array([t.decode() for t in texts])], ["to", "doc_id", "text"])
    sent = pa.Table.from_batches(list(m._send_dictionary(64, 7)([batch])))
    marks = [r for r in sent.to_pylist() if r["kind"] == m.IS_HOT]
    assert marks
    largest = max(np.unique(np.frombuffer(r["a"], "u4"), return_counts=True)[1].max() for r in sent.to_pylist() if r["kind"] == m.DICTIONARY)
    assert largest <= m.HOT
    hot = np.unique(np.concatenate([np.frombuffer(r["a"], "u8") for r in marks]))
    ids = list(range(len(texts)))
    windows = [r for b in m._hot_windows(hot, ids, m.parse(texts, 7), 64, 0, 7) for r in b.to_pylist()]
    per = np.bincount([r["to"] for r in windows for _ in range(len(r["b"]) // 16)], minlength=64)
    assert per.max() < 1.5 * per.mean()


def thue_morse_pair(blocks=2048):
    """Two texts without a common window of which sums under any odd base modulo 2^64 are equal.

    Blocks are a common trigger of low hash, a letter that is x or y by the Thue-Morse sequence and its complement, and nine letters of the block's own.
    """
    rng = random.Random(8)
    letters = np.random.default_rng(8).integers(97, 105, (2_000_000, m.TRIGGER), "u1")
    sums = np.zeros(len(letters), "u8")
    for k in range(m.TRIGGER):
        sums += m._CODES[letters[:, k]] * m._Powers.up[k]
    low = letters[m.mixed(sums).argmin()].tobytes().decode()
    middles = ["".join(rng.choices("klmnopqrstuvw", k=9)) for _ in range(blocks)]
    bit = [bin(k).count("1") % 2 for k in range(blocks)]
    return ["".join(low + "xy"[b ^ flip] + mid for b, mid in zip(bit, middles, strict=True)) for flip in (0, 1)]


def test_texts_with_equal_sums_are_not_taken_for_equal(spark):
    one, two = thue_morse_pair()
    assert not {one[i : i + 50] for i in range(len(one) - 49)} & {two[i : i + 50] for i in range(len(two) - 49)}
    parsed = [m.parse([t.encode()], 7) for t in (one, two)]
    assert [len(p[0]) for p in parsed] == [1, 1] and parsed[0][0] == parsed[1][0]  # a phrase each, of one trigger
    frame = spark.createDataFrame([(1, one), (2, two), (3, one[100:400] + "!" + two[7:200])], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in m.repeated(frame).collect()} == {1: (0, 0), 2: (0, 0), 3: (493, 2)}


def test_names_depend_on_the_run():
    texts = [b"the quick brown fox jumps over the lazy dog and runs away from here"]
    assert (m.parse(texts, 1)[1] != m.parse(texts, 2)[1]).all() and (m.parse(texts, 1)[1] == m.parse(texts, 1)[1]).all()
    assert (m.window_prints(np.frombuffer(texts[0], "u1"), np.arange(3), 1) != m.window_prints(np.frombuffer(texts[0], "u1"), np.arange(3), 2)).all()


def test_names_that_share_a_half():
    halves = [b"aaaaaaa1", b"aaaaaaa2", b"zzzzzzz3"]
    names = np.array([a + b for a in halves for b in (b"11111111", b"22222221", b"33333333")], m.NAME)
    mixed_up = names[np.random.default_rng(0).permutation(np.tile(np.arange(9), 4))]
    assert (mixed_up[m._ordered(mixed_up)] == np.sort(mixed_up)).all()
    place, there = m._Names(names[:-1]).find(names)
    assert there.tolist() == [True] * 8 + [False] and place[:8].tolist() == list(range(8))
