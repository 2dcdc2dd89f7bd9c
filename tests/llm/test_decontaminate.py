import random
import time

import numpy as np

from quarry.llm import decontaminate as m
from tests.parity import SF, same

ITEM = " ".join(f"w{i}" for i in range(20))


def test_parity(spark):
    same(spark, m.query, m.SQL)


def test_edges_against_brute_force(spark):
    docs = [
        (1, f"before {ITEM.upper()} after"), (2, None), (3, ""), (4, "short item"), (4, "short item"), (5, "x, SHORT--Item! " + "pad " * 60), (6, " ".join(f"w{i}" for i in range(12))),
        (7, f"{ITEM} " * 300), (8, "été w3"), (9, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 " * 2),
    ]
    items = [(10, ITEM), (2, "short item"), (2, "short item"), (3, ""), (4, None), (None, "été"), (7, ITEM)]
    frame = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in docs], "doc_id long, text string, found string, `a.b` int, c0 int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(m.expected(docs, items))
    assert sorted(tuple(r) for r in m.contamination(frame, bench).collect()) == want
    for size in (1 << 20, 40):
        found = m.scanned(frame.select("doc_id", "text"), bench, size).select("c0", m._hit().alias("n"), "found.items").collect()
        assert sorted((r.c0, r.n, len(r["items"])) for r in found) == sorted((w[0], w[2], w[3]) for w in want)
    clean = m.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(tuple(r) for r in clean.collect()) == sorted((d, t, "clash", 1, 2) for d, t in docs if not m.expected([(d, t)], items)[0][5])


def test_random_texts_against_brute_force():
    rng = random.Random(8)
    for turn in range(60):
        letters = [f"w{k}" for k in range(rng.choice([2, 4, 30]))]
        items = [(k % 7, " ".join(rng.choices(letters, k=rng.choice([1, 2, 5, 12, 13, 14, 20, 40])))) for k in range(rng.randint(1, 12))]
        docs = []
        for d in range(rng.randint(1, 12)):
            parts = [" ".join(rng.choices([*letters, "other"], k=rng.randint(0, 20))) for _ in range(4)]
            parts.insert(2, " ".join(rng.choice(items)[1].split()[: rng.randint(1, 40)]))
            docs.append((d, " ".join(parts * rng.choice([1, 1, 12]))))
        counts, runs, own = m.Windows(items).scan([t for _, t in docs])
        got = [(d, int(n), int((r[:, 1] - r[:, 0]).sum()), len(o)) for (d, _), n, r, o in zip(docs, counts, runs, own)]
        assert got == [w[:4] for w in m.expected(docs, items)], turn


def test_a_large_benchmark_is_one_automaton():
    rng = np.random.default_rng(0)
    items = [(k, " ".join(f"w{x}" for x in rng.zipf(1.3, 200) % 60_000)) for k in range(8000)]
    size = sum(len(t) for _, t in items)
    began = time.perf_counter()
    windows = m.Windows(items)
    held = sum(v.nbytes for v in vars(windows).values() if hasattr(v, "nbytes"))
    assert held < 40 * 8000 * 200 and size < m.BLOCK_BYTES and time.perf_counter() - began < 60
    counts, runs, own = windows.scan([items[5][1], f"x {items[7][1]} y", "nothing here"])
    assert own[0].tolist() == [5] and own[1].tolist() == [7] and [r.tolist() for r in runs] == [[[0, 200]], [[1, 201]], []]


def test_clean_documents_keep_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, 5), (2, "fine", 6), (3, None, 7)], "doc_id long, text string, hits int")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = m.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert m.clean_documents(docs.limit(0), bench).count() == 0
    assert m.clean_documents(docs, bench.limit(0)).count() == 3


def test_spans_are_offsets_of_the_original(spark):
    text = "É! short,  ITEM."
    spans = m.contaminated_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, "Short item")], "item_id long, text string")).first()["spans"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["short,  ITEM"]


def test_query_reads_whole_table(spark):
    assert m.query(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
