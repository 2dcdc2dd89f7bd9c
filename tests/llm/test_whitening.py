import math

import numpy as np
import pytest

from quarry.llm import whitening as m

SF = "/root/testdata/sf0.01"


def brute(rows, components=4):
    """vec_id -> (n, deviation, whitened) and explained, from the whole matrix."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * float(c)) for c in v] for _, v in good], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    z = np.array((fit * n - sums) / n, dtype="f8")
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    own = np.array((x * n - sums) / n, dtype="f8") @ vectors / np.sqrt(values)
    deviation = [int(sum(int(v) ** 2 for v in r)) for r in x * n - sums]
    return [i for i, _ in good], n, deviation, own, values / (np.array([int(v) for v in ((fit * n - sums) ** 2).sum(1)], dtype=object).sum() / n**3), vectors


def compare(got, rows, components=4):
    ids, n, deviation, own, explained, _ = brute(rows, components)
    found = {}
    for r in got:
        found.setdefault(r.vec_id, []).append(r)
    assert sorted(found) == sorted(set(ids))
    k = len(explained)
    matrix = np.array([[r.whitened for r in sorted(found[i], key=lambda r: r.component)[:k]] for i in ids])
    signs = np.sign((matrix * own).sum(0))
    assert np.abs(matrix - own * signs).max() < 1e-8
    for i, d in zip(ids, deviation, strict=True):
        for r in found[i]:
            assert r.n == n and int(r.deviation_text) == d and r.deviation == (d if d < 2**63 else None)
            assert abs(r.explained - explained[r.component - 1]) <= 1e-10
            assert 0 <= r.identity_error <= 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_query_against_the_whole_matrix(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = m.query(spark, SF).collect()
    compare(got, rows)
    assert len(got) == 4 * len(brute(rows)[0])


def test_edges(spark):
    rng = np.random.default_rng(1)
    vectors = [[float(v) for v in rng.normal(0, 3, 5) * [5, 4, 3, 2, 1]] for _ in range(60)]
    rows = list(enumerate(vectors)) + [(100 + k, vectors[0]) for k in range(30)]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [1.0]), (205, [])]
    frame = spark.createDataFrame([(i, v, "a", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, component string, n int")
    compare(m.whitened(frame).collect(), rows)
    assert m.whitened(frame.limit(0)).count() == 0
    same = frame.filter("vec_id >= 100")
    assert m.whitened(same).count() == 0  # one distinct vector: no variance
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0])], "vec_id int, embedding array<float>")
    got = m.whitened(two).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == [("1", 1), ("2", 1), ("None", 1)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and abs(r.explained - 1) < 1e-12 for r in got)


def test_deviations_beyond_64_bits(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(0, 1e9, 3)]) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = m.whitened(frame, components=3).collect()
    assert any(r.deviation is None for r in got)
    compare(got, rows, 3)


@pytest.mark.parametrize("d, kind", [(300, "spread"), (300, "tied"), (40, "low rank"), (6, "all"), (1, "all")])
def test_block_lanczos_restarts_and_breaks_down(d, kind):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {"spread": np.arange(d, 0, -1.0), "tied": np.repeat([9.0, 4.0, 1.0], [3, 5, d - 8]) if d > 8 else None, "low rank": np.array([5.0, 2.0] + [0.0] * (d - 2)) if d > 2 else None, "all": np.arange(d, 0, -1.0)}[kind]
    v = (q * values) @ q.T
    got, vectors = m.block_lanczos(lambda b: v @ b, d, 4, block=3, most=24, rounds=400)
    k = min(4, d)
    assert np.allclose(got, np.sort(values)[::-1][:k], atol=1e-10)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-10
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_breakdown_replaces_columns():
    rng = np.random.default_rng(0)
    basis = np.eye(5)[:, :2]
    got = m._fresh(np.column_stack([basis[:, 0], basis[:, 1], np.zeros(5)]), basis, rng)
    whole = np.column_stack([basis, got])
    assert got.shape[1] == 3 and np.allclose(whole.T @ whole, np.eye(5), atol=1e-12)
