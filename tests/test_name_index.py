import random
import re

from pyspark.sql import functions as F

from quarry.operators import name_index, names

FILE = "project string, file string, content string"


def rows_of(frame):
    return sorted((r.project, r.name, r.occurrences, r.files) for r in frame.collect())


def test_a_kept_index_equals_the_texts_after_every_update(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(name_index, "RUN", 8)
    rng, path = random.Random(1), str(tmp_path / "index")
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma_1", "delta", "f(x)"]) for _ in range(rng.randint(0, 12)))
    state = {(rng.choice("pq"), f"f{k}"): text() for k in range(40)}
    wanted = spark.createDataFrame([(p, n) for p in "pq" for n in ("alpha", "gamma_1", "x", "nowhere")], "project string, name string")
    frame = lambda s: spark.createDataFrame([(p, f, t) for (p, f), t in s.items()], FILE)
    assert name_index.lookup(spark, path, wanted).count() == 0
    changed, removed = dict(state), None
    for step in range(3):
        done = name_index.update(frame(state), path, removed)
        assert done == len(changed), step
        assert rows_of(name_index.lookup(spark, path, wanted)) == rows_of(names.lookup(frame(state), wanted)), step
        gone = rng.sample(sorted(state), 3)
        removed = spark.createDataFrame(gone, "project string, file string")
        state = {k: v for k, v in state.items() if k not in gone}
        changed = {k: state[k] + " alpha new" for k in rng.sample(sorted(state), 4)} | {("p", f"n{step}"): "alpha"}
        state |= changed
    assert name_index.update(frame(state), path, removed) == len(changed) and name_index.update(frame(state), path) == 0
    want = rows_of(names.lookup(frame(state), wanted))
    assert rows_of(name_index.lookup(spark, path, wanted)) == want
    name_index.compact(spark, path, f"{path}-2")
    assert rows_of(name_index.lookup(spark, f"{path}-2", wanted)) == want
    few = spark.read.parquet(f"{path}-2/postings").count()
    assert few < spark.read.parquet(f"{path}/postings").count()


def test_a_lookup_opens_the_wanted_tokens_folders_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    files = spark.range(300).selectExpr("'p' AS project", "concat('f', id) AS file", "concat('name', id, ' shared other', id % 7) AS content")
    name_index.update(files, path)
    wanted = spark.createDataFrame([("p", "name17")], "project string, name string")
    found = name_index.postings(spark, path, wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(name_index._bucket(F.lit("p"), F.lit("name17"))).first()[0]
    assert re.search(rf"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = {bucket}\)\]", plan) and [r.n for r in found.collect()] == [1]
    there = spark.read.parquet(f"{path}/postings").groupBy("bucket").count()
    assert there.count() > 50 and rows_of(name_index.lookup(spark, path, wanted)) == [("p", "name17", 1, 1)]


def test_blocks_are_made_without_a_shuffle_of_pairs(spark):
    files = spark.createDataFrame([("p", 0, "a b a"), ("p", 1, "a"), ("q", 2, "a"), ("p", 3, None), ("p", 4, "- -"), ("p", name_index.RUN + 1, "b")], "project string, number long, content string")
    blocks = name_index._postings(files, names.TOKEN)
    got = {(r.project, r.token, r.run): (r.offsets, r.counts) for r in blocks.collect()}
    assert got == {("p", "a", 0): ([0, 1], [2, 1]), ("p", "b", 0): ([0], [1]), ("q", "a", 0): ([2], [1]), ("p", "b", 1): ([1], [1])}
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_a_tasks_blocks_equal_brute_force(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(name_index, "TOKENS", 25)
    rng = random.Random(5)
    rows = [(rng.choice(["p", "q", None]), k, rng.choice([None, []]) if rng.random() < 0.2 else [rng.choice(["a", "b", "é", "zz"]) for _ in range(rng.choice([1, 7, 60]))]) for k in range(3, 60)]
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["project", "number", "tokens"])
    want = {(p, t, k): ts.count(t) for p, k, ts in rows[5:] for t in set(ts or [])}
    got, made = {}, list(name_index._own_blocks(8)(iter([whole.slice(5), whole.slice(0, 0)])))
    for block in (r for b in made for r in b.to_pylist()):
        assert block["p"] == sorted(block["p"])
        for x in block["p"]:
            key = (block["project"], block["token"], block["run"] * 8 + (x >> 32))
            assert key not in got
            got[key] = x & ((1 << 32) - 1)
    assert got == want and len(made) > 5
