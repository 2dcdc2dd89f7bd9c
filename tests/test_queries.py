import pytest

from quarry import catalog
from tests.parity import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_parity(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name])


def test_findings_of_every_document(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.findings for r in catalog.QUERIES["files_with_findings"](spark, sf).collect()}
    assert got.keys() == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sum(got.values()) == catalog.QUERIES["pattern_findings"](spark, sf).count() > 0


def test_entry_imports_without_the_optional_parts(monkeypatch):
    import builtins
    import importlib

    import __spark_entry__

    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("gone", name="corpus_pipeline")
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", without)
    assert set(importlib.reload(__spark_entry__).queries()) == set(catalog.QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
