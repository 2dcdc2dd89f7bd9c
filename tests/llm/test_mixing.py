import math
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import mixing as m
from tests.parity import SF


def brute_targets(sizes):
    """sizes: source -> words; shares are given again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    left = m.SHARE * sum(sizes.values())
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        share = left / total
        left = 0.0
        for s in sorted(free, key=str):
            target[s] += share * weight[s]
        for s in list(free):
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free.discard(s)
    return target


def checked(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    placed, pieces = m.mix(frame, block_words=16, shard_blocks=4)
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) for r in placed.collect())
    got = pieces.collect()
    taken = Counter()
    for p in got:
        taken[p.source] += p.word_end - p.word_start
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in want)
    words = Counter()
    for p in got:
        for w in range(p.word_start, p.word_end):
            words[p.doc_id, p.source, p.__getattr__("pass"), w] += 1
    assert all(n == 1 for n in words.values())
    return got


def test_targets_pieces_and_no_double_use(spark):
    rows = [(i, f"s{i % 4}", "w " * (i % 37)) for i in range(120)] + [(500, None, "a b c"), (501, "hot", "x " * 3000), (502, "s1", None), (503, "", "one")]
    got = checked(spark, rows)
    shards = Counter()
    for p in got:
        shards[p.shard] += p.word_end - p.word_start
    assert len(shards) > 10 and max(shards.values()) <= 16 * 5


def test_empty_and_all_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, source string, text string")
    placed, pieces = m.mix(frame)
    assert placed.count() == 0 and pieces.count() == 0
    assert m.mixed_documents(frame.withColumn("extra", F.lit(1))).count() == 0
    checked(spark, [(1, "a", ""), (2, None, None)])


def test_reruns_agree(spark):
    assert sorted(map(tuple, m.query(spark, SF).collect())) == sorted(map(tuple, m.query(spark, SF).collect()))


def test_query_bounds(spark):
    rows = m.query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)


def test_tree_is_exact_at_every_shard(spark):
    counts = spark.createDataFrame(list(enumerate([1000, 0, 7, 333])), "sid int, blocks long")
    rows = m.splitting_tree(counts, 13, 5).collect()
    per_source, per_shard = Counter(), Counter()
    runs = {}
    for r in rows:
        per_source[r.sid] += r.blocks
        per_shard[r.shard] += r.blocks
        runs.setdefault(r.sid, []).append((r.first, r.blocks))
    assert [per_source[k] for k in range(4)] == [1000, 0, 7, 333]
    assert max(per_shard.values()) - min(per_shard.values()) <= 2
    for own in runs.values():
        at = 0
        for first, n in sorted(own):
            assert first == at or n == 0
            at += n


def test_hypergeometric_distribution(spark):
    pool, good, draws, n = 30, 12, 9, 20_000
    u = (F.col("id") + 0.5) / n
    got = spark.range(n).select(m.hypergeometric(F.lit(pool), F.lit(good), F.lit(draws), u).alias("x")).groupBy("x").count().collect()
    for r in got:
        want = math.comb(good, r.x) * math.comb(pool - good, draws - r.x) / math.comb(pool, draws)
        assert abs(r["count"] / n - want) < 1e-3


def test_cut_documents_keep_their_white_space(spark):
    text = spark.range(1).select(m.first_words(F.lit(" a  b\tc d"), F.lit(3)).alias("x")).first()["x"]
    assert text == " a  b\tc"


def plain_streams(rows, block_words, seed, spark):
    """Words that the mix takes of each row, from the streams alone: the front of each, going round."""
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    order = m.streams(m.sizes(frame), m.source_targets(m.sizes(frame)).withColumn("quota", F.round("target").cast("long")), len(rows), True, seed).collect()
    out = Counter()
    by_source = {}
    for r in order:
        by_source.setdefault(r.source, []).append(r)
    for s, own in by_source.items():
        left = own[0].quota
        for turn in range(2):
            for r in sorted(own, key=lambda r: (r.begin, r.begin + r.size)):
                took = min(left, r.size)
                left -= took
                out[r.doc_id, r.source, r.tie, r.copy] += took
    return out


def rows_of_kinds():
    rows = [(i, f"s{i % 4}", "w " * (i % 37)) for i in range(120)] + [(500, None, "a b c"), (501, "hot", "x " * 3000), (502, "s1", None), (503, "", "one"), (None, None, None)]
    return rows + [(1, "s1", "equal rows stay rows of their own " * 3)] * 9 + [(1, "s2", "equal rows")] * 2 + [(None, "s1", "no id")] * 3


def test_taken_against_the_streams(spark):
    rows = rows_of_kinds()
    want = plain_streams(rows, 16, 7, spark)
    for few in (50_000, 0):
        m.BROADCAST_SOURCES, before = few, m.BROADCAST_SOURCES
        try:
            placed, pieces = m.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_words=16, shard_blocks=4)
            got = Counter()
            for p in pieces.collect():
                got[p.doc_id, p.source, p.tie, p.copy] += p.word_end - p.word_start
            assert placed.count() == len(rows) == len(want)
            assert got == +want
        finally:
            m.BROADCAST_SOURCES = before


def test_documents_follow_the_pieces_and_keep_columns(spark):
    rows = rows_of_kinds()
    names = "doc_id long, source string, text string, n_chars int, `a.b` int, _id int, _from int, pass int, copy int, key int, row int, tie int, size int"
    frame = spark.createDataFrame([(d, s, t, len(t or ""), k, 1, 2, 3, 4, 5, 6, 7, 8) for k, (d, s, t) in enumerate(rows)], names)
    out = m.mixed_documents(frame, block_words=16, shard_blocks=4)
    assert out.columns == frame.columns
    got = out.collect()
    _, pieces = m.mix(frame, block_words=16, shard_blocks=4)
    want = Counter()
    for p in pieces.collect():
        want[p.doc_id, p.source, p.tie, p.copy, p["pass"]] += p.word_end - p.word_start
    told = lambda pairs: sorted(map(repr, pairs))
    assert told((r.doc_id, r.source, len(r.text.split())) for r in got) == told((k[0], k[1], n) for k, n in want.items())
    assert all(r.n_chars == len(r.text) and (r._id, r["pass"], r["key"], r["size"]) == (1, 3, 5, 8) and rows[r["a.b"]][:2] == (r.doc_id, r.source) for r in got)
    per_row = Counter(r["a.b"] for r in got)
    assert max(per_row.values()) <= 2


def test_blocks_meet_by_shuffle_however_many(spark):
    rows = [(i, f"s{i % 3}", "w " * 50) for i in range(400)]
    _, pieces = m.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_words=1, shard_blocks=64)
    assert pieces.count() == 30_000
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [sid" in plan and "BroadcastHashJoin [sid" not in plan


def test_rows_of_equal_id_are_documents_of_their_own(spark):
    rows = [(1, "a", "one two three")] * 4 + [(1, "b", "one")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    placed, _ = m.mix(frame)
    assert placed.count() == 5 and m.mixed_documents(frame).count() >= 5
