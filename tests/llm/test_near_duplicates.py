import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import dart_minhash
from quarry.llm import near_duplicates as m
from quarry.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.01"


def brute(rows, least=m.LEAST):
    """doc_id -> least doc_id that links connect it to, over all pairs."""
    sets = [set(e.tolist()) for e, _ in shingle_sets([t for _, t in rows])]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    low = {}
    for k, (d, _) in enumerate(rows):
        low[find(k)] = min(d, low.get(find(k), d))
    return {d: low[find(k)] for k, (d, _) in enumerate(rows)}


def test_classes_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400").collect()]
    got = {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_query_reads_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    assert m.query(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_large_buckets_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 8)
    random.seed(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(60):
        words = list(base)
        words[random.randrange(150)] = f"x{d}"
        rows.append((d, " ".join(words)))
    rows += [(100 + d, rows[d][1]) for d in range(30)] + [(900, "something else entirely " * 30)]
    got = {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_repeated_rows_do_not_merge_buckets(spark):
    rng = random.Random(3)
    rows = []
    for pair in range(12):
        words = [f"p{pair}w{rng.randrange(10**6)}" for _ in range(200)]
        near = [*words[:-1], "other"]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(near))]
    want = {d: d - d % 2 for d, _ in rows}
    schema = "doc_id long, text string"
    for repeated in (rows, rows * 2, rows * 3 + rows[:9]):
        assert {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(repeated, schema)).collect()} == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "a b"), (5, "A, b!"), (6, "one two three four five"), (7, "one two three four five"), (None, "a b"), (7, "one two three four five"), (8, "long word " * 60_000)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string")
    got = m.classes(frame).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, None: None, 8: 8}
    kept = m.one_of_each(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, None, 8}
    assert m.classes(frame.limit(0)).count() == 0


def test_one_row_of_each_stays(spark):
    one, two = "one two three four five six", "an own text of quite other words"
    rows = [(1, one), (1, one), (1, "One, two three four five six!"), (2, one), (3, two), (4, None), (4, None), (5, one), (5, "yet another text with its words")]
    rows += [(None, "a b c"), (None, "A b c"), (None, "a b c"), (None, None), (None, "")]
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, kept string, `a.b` string")
    kept = m.one_of_each(frame)
    assert kept.columns == frame.columns
    got = [(r[0], r[1], r[2], r[3]) for r in kept.collect()]
    want = [(1, "One, two three four five six!"), (3, two), (4, None), (5, "yet another text with its words"), (None, "A b c"), (None, None), (None, "")]
    assert sorted(map(repr, got)) == sorted(repr((d, t, "x", "y")) for d, t in want)


def test_rows_that_stay_by_filter_and_by_join_agree(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k // 3}x{j}" for j in range(30)), k) for k in range(90)] + [(200, None, 1), (None, "a b", 2), (5, "w1x0", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = []
    for most in (1 << 24, 2):
        monkeypatch.setattr(m, "MOST_IDS", most)
        got.append(sorted(map(repr, m.one_of_each(frame).collect())))
    assert got[0] == got[1] and len(got[0]) == 33


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.label for r in m.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 60, dtype="u8")
    a, b = rng.uniform(0.2, 4, 60), rng.uniform(0.2, 4, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = [(s[0] == s[1]).mean() for s in (dart_minhash.signatures([(x + np.uint64(i), a), (x + np.uint64(i), b)], 96) for i in range(40))]
    assert abs(np.mean(agree) - want) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    sets = [(e, np.ones(len(e))) for e, _ in shingle_sets(["a b c d e f g", "h i j k l m", "a b"])]
    whole = dart_minhash.signatures(sets, 32)
    assert all((dart_minhash.signatures([s], 32)[0] == w).all() for s, w in zip(sets, whole, strict=True))


def boilerplate(rng, n, share, words=120):
    """Texts that have a run of words in common and differ in the rest."""
    common = [f"c{k}" for k in range(int(words * share))]
    return [" ".join(common + [f"u{rng.randrange(10**9)}" for _ in range(words - len(common))]) for _ in range(n)]


@pytest.mark.parametrize("share", [0.5, 0.7, 0.86])
def test_large_buckets_of_unlike_texts(spark, monkeypatch, share):
    monkeypatch.setattr(m, "BLOCK", 16)
    rng = random.Random(6)
    texts = boilerplate(rng, 150, share)
    texts += [" ".join(t.split()[:-1] + ["x"]) for t in texts[:40]]
    texts += [" ".join([*(f"n{k}" for k in range(60)), f"v{k}"]) for k in range(70)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_unlike_texts_of_a_bucket_are_not_paired(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 32)
    counts = []
    for n in (200, 800):
        rows = list(enumerate(boilerplate(random.Random(7), n, 0.7)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        members = docs.select(F.col("doc_id").alias("rep"), F.col("doc_id").alias("label")).join(m.signed(docs).select(F.col("doc_id").alias("rep"), "s1"), "rep")
        counts.append(m.prefix_groups(docs, members).count())
    # All pairs of blocks would be 16 times as many.
    assert counts[1] <= 5 * max(counts[0], 100)


def test_ids_by_filter_and_by_join_agree(spark, monkeypatch):
    rows = [(k, " ".join(f"w{k // 3}x{j}" for j in range(40))) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for most in (1 << 25, 3):
        monkeypatch.setattr(m, "MOST_IDS", most)
        got.append(sorted(map(tuple, m.classes(frame).collect())))
    assert got[0] == got[1] and all(c == d - d % 3 for d, c, _ in got[0])


def test_recall_at_the_threshold(spark):
    """Pairs with a similarity just above 0.8: all but a few in a million are met, so of these all are found."""
    rng = random.Random(9)
    rows, near = [], 0
    for pair in range(1500):
        words = [f"p{pair}w{j}" for j in range(200)]
        other = list(words)
        at = rng.sample(range(0, 196, 7), 4)
        for j in at[: rng.choice([3, 4])]:
            other[j] = f"q{j}"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    want = {}
    for k in range(0, len(rows), 2):
        want |= brute(rows[k : k + 2])
    got = {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [d for d in want if d % 2 and want[d] != d]
    assert len(near) > 1000
    assert sum(got[d] == want[d] for d in near) / len(near) >= 0.999
