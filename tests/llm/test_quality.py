import zlib

import numpy as np

from quarry.llm import quality as m

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = m.query(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = rows.join(labels, "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert np.mean([r.predicted for r in out if r.quality == 1]) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "word " * 200_000, 3), (None, "text", 4), (1, None, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, quality int")
    model = m.fit(m.measured(docs), labels)
    scores = [r.score for r in m.scored(m.measured(docs), model).collect()]
    assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
    assert m.good_documents(docs, labels).columns == docs.columns
    assert m.good_documents(docs.limit(0), labels).count() == 0
    assert m.fit(m.measured(docs), labels.limit(0)).prior == 0.5


def test_density_matches_the_formula():
    rng = np.random.default_rng(0)
    sums = {}
    data = {}
    for k in (0, 1):
        x = rng.normal(k, 1 + k, (500, m.N))
        data[k] = x
        sums[k] = np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
    model = m.solve(sums)
    x = rng.normal(0.5, 1, (20, m.N))
    z = (x - model.centre) / model.scale
    log = []
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        d = z - model.means[k]
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-(log[1] - log[0])))
    assert np.allclose(model.scores(x), want, atol=1e-6)


def test_training_rows_leave_out_the_held_out(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in m.training(labels).collect())
