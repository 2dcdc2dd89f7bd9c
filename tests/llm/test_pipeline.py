import os

import pytest

import corpus_pipeline
from quarry.llm import decontaminate, mixing, near_duplicates, quality
from quarry.llm._common import shared_dir, written

SF = "/root/testdata/sf0.01"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), "test")
        seen[name] = (before, docs)
        if name != "token records":
            assert docs.columns == columns
    before, after = seen["near-duplicate removal"]
    assert {r.doc_id for r in after.collect()} == {r.class_id for r in near_duplicates.classes(before).collect()}
    before, after = seen["benchmark decontamination"]
    judged = decontaminate.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged.filter("NOT contaminated").collect()}
    before, after = seen["source mixing"]
    size = mixing.sizes(after).groupBy().sum("size").first()[0]
    assert abs(size - 1.5 * mixing.sizes(before).groupBy().sum("size").first()[0]) < 200
    before, after = seen["token records"]
    assert after.count() == before.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = seen["quality classifier"]
    good = before.join(labels, "doc_id").filter("quality = 1")
    kept = after.join(labels, "doc_id").filter("quality = 1")
    assert kept.count() > 0.95 * good.count()
    assert quality.KEEP_FROM == 0.7


def test_stage_names_and_run(spark):
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


EXTRA = "doc_id long, text string, lang string, source string, n_chars int, found int, kept int, _id int, pass int, `a.b` int, row int, key int, c0 int, text_ int"


def made(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), *range(9)) for d, t, s in rows], EXTRA)


@pytest.fixture
def small(spark, tmp_path):
    """A folder with the tables that the stages read besides documents."""
    good = "This is a sound and ordinary sentence about rivers, bridges and towns of the north. "
    labels = [(k, k % 2) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(15)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = "alder birch cedar dogwood elm fir gum hazel ivy juniper".split()
    lines = lambda k: " ".join(good.replace("rivers", f"{names[k % 10]} and {names[k // 10]}").replace("towns", f"towns {names[j]}") for j in range(3 + k % 7))
    rows = [(k, lines(k) if k % 2 else "BUY!!! $$$ 111 ### " * (3 + k) + f"number {k}", f"s{k % 3}") for k in range(40)]
    return str(tmp_path), rows


def test_edges_of_every_stage(spark, small):
    sf, rows = small
    contaminated = "A sound text with words. " * 3 + " ".join(f"q{k}" for k in range(15))
    rows = rows + [rows[1]] * 3 + [(100, None, None), (101, "", "s1"), (None, None, "s2"), (102, contaminated, "s0"), (103, "long words of a sentence. " * 40_000, "s1"), (104, rows[3][1], "s2")]
    docs = made(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() >= 0 and stage(spark, docs.limit(0), sf).count() == 0
        got = {r.doc_id for r in out.collect()}
        if name == "near-duplicate removal":
            assert out.filter("doc_id = 1").count() == 1 and 104 not in got
        if name == "benchmark decontamination":
            assert 102 not in got and len(got) == len({r[0] for r in rows}) - 1
    index = corpus_pipeline.apply(spark, docs, sf)
    kept = index.collect()
    assert kept and 102 not in {r.doc_id for r in kept}
    assert corpus_pipeline.apply(spark, docs.limit(0), sf).count() == 0


def test_run_keeps_only_the_product(spark, small):
    sf, rows = small
    at = shared_dir(spark).removeprefix("file://") + "/quarry"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    corpus_pipeline.apply(spark, made(spark, rows), sf).count()
    assert [n.split("-")[0] for n in set(os.listdir(at)) - before] == ["tokens"]


def plain_run(spark, docs, sf, rows):
    """doc_id of the records, from each stage's rule applied by hand to what the one before kept."""
    scores = {r.doc_id for r in quality.good_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    kept = [r for r in rows if r[0] in scores]
    sets = {d: {tuple(t.lower().replace(",", " ").replace(".", " ").split()[k : k + 5]) for k in range(max(1, len(t.lower().replace(",", " ").replace(".", " ").split()) - 4))} for d, t, _ in kept}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [r for r in kept if find(r[0]) == r[0]]
    item = " ".join(f"q{k}" for k in range(15))
    hit = {r[0]: 15 if item in r[1] else 0 for r in kept}
    kept = [r for r in kept if not hit[r[0]] or 20 * hit[r[0]] < len(r[1].split())]
    sizes = {}
    for _, t, s in kept:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    return {r[0] for r in kept}, sizes


def test_run_against_the_rules_by_hand(spark, small):
    from tests.llm.test_mixing import brute_targets

    sf, rows = small
    rows = rows + [(200 + k, rows[k][1], "s1") for k in range(0, 40, 5)] + [(300, "An own sentence about rivers of the south. " * 3 + " ".join(f"q{k}" for k in range(15)), "s0")]
    docs = made(spark, rows)
    want, sizes = plain_run(spark, docs, sf, rows)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, sf)
    assert {r.doc_id for r in kept.collect()} == want and 300 not in want and len(want) > 8
    mixed = corpus_pipeline.STAGES[3][1](spark, kept, sf).collect()
    words = {}
    for r in mixed:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    targets = brute_targets(sizes)
    assert all(abs(words[s] - targets[s]) <= 0.5 for s in targets)
    index = corpus_pipeline.apply(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in index) == sorted(r.doc_id for r in mixed)
