import random
import re
from collections import Counter

from quarry import catalog
from quarry.operators import names
from tests.parity import same

FILE = "project string, file string, content string"


def some_files(rng, n):
    text = lambda: None if rng.random() < 0.1 else " ".join(rng.choice(["a", "bb", "c_1", "é", "-", "Z9", f"own{rng.random()}"]) for _ in range(rng.randint(0, 9)))
    return [(rng.choice("pq"), f"f{k}", text()) for k in range(n)]


def test_index_takes_all_rows_of_a_file(spark):
    files = [*some_files(random.Random(3), 40), ("p", "f1", "a a twice"), ("p", None, "a"), ("p", None, "a b")]
    want = Counter((p, f, t) for p, f, text in files for t in re.findall(names.TOKEN, text or ""))
    got = [((r.project, r.file, r.token), r.n) for r in names.index(spark.createDataFrame(files, FILE)).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_counts_elsewhere_by_brute_force(spark):
    for more in ([], [("p", "f1", "a alone twice"), ("p", "f1", "a twice other"), ("q", None, "bb nowhere"), ("q", None, "bb Z9 nowhere")]):
        files = [*some_files(random.Random(4), 30), *more]
        where = {}
        for p, f, text in files:
            for t in re.findall(names.TOKEN, text or ""):
                where.setdefault((p, t), set()).add(f)
        shared = {k for k, fs in where.items() if len(fs - {None}) > 1}
        pairs = {(p, f, t) for (p, t), fs in where.items() for f in fs if (p, t) in shared}
        got = [((r.project, r.file), r.names) for r in names.counts_elsewhere(spark.createDataFrame(files, FILE)).collect()]
        assert len(got) == len(dict(got)) and dict(got) == Counter((p, f) for p, f, _ in pairs)


def test_names_elsewhere_with_repeated_and_missing_ids(spark, tmp_path):
    docs = [(1, "a b"), (1, "b c"), (2, "b d"), (None, "b e"), (None, "d b e"), (3, None), (4, "e"), (5, "- -"), (6, "d")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    next((tmp_path / "in").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    same(spark, catalog.QUERIES["names_elsewhere"], catalog.ORACLES["names_elsewhere"], str(tmp_path))
