import os
import subprocess

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, LessThan, StringEndsWith, StringStartsWith

from quarry.sources import files, listing


@pytest.fixture
def tree(tmp_path):
    names = (
        "src/a.ts", "src/deep/node_modules/x/i.js", "src/deep/b.py", "b.min.js", "c.py", "test/baselines/x.ts", "pkg/bin/Debug/o.cs", "pkg/bin/ok.cs", "lib/sub/m.go", "lib/own.go",
        "a.b/cases/one.ts", "a.b/cases/two.js", "é/ü.rb",
    )
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"// {name}")
    (tmp_path / ".gitmodules").write_text('[submodule "x"]\n  path = lib/sub\n  url = y\n')
    (tmp_path / "latin.py").write_bytes(b"x = '\xe9'\n")
    os.symlink(tmp_path, tmp_path / "src" / "loop")
    return tmp_path


KEPT = {".gitmodules", "src/a.ts", "src/deep/b.py", "c.py", "pkg/bin/ok.cs", "lib/own.go", "a.b/cases/two.js", "é/ü.rb", "latin.py"}


@pytest.mark.parametrize("splits", ["1", "3", "256"])
def test_the_same_files_however_many_levels_the_driver_lists(spark, tree, splits):
    got = files.listed(spark, f"file://{tree}", splits=splits).collect()
    assert {r.file for r in got} == KEPT and len(got) == len(KEPT)
    assert {r.file: r.content for r in got if r.file != "latin.py" and r.file[0] != "."} == {n: f"// {n}" for n in KEPT if n != "latin.py" and n[0] != "."}
    assert {r.status for r in got} == {"read"} and all(r.size == os.path.getsize(tree / r.file) for r in got)


def test_excluded_directories_are_never_opened(spark, tree, monkeypatch):
    """Neither listed nor read: a store that refuses every path in an excluded directory is not asked."""
    asked = []
    entries, read = listing._Local.entries, listing._Local.read
    monkeypatch.setattr(listing._Local, "entries", lambda self, path: asked.append(path) or entries(self, path))
    monkeypatch.setattr(listing._Local, "read", lambda self, path: asked.append(path) or read(self, path))
    options = {"path": str(tree), "dirs": "\n".join(files.EXCLUDED_DIRS), "patterns": f"{files.EXCLUDED_NAMES}\n{files.EXCLUDED_PATHS}", "submodules": "true"}
    reader = listing.TreeReader(options)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["file"] for r in rows} == KEPT
    assert not [p for p in asked if "node_modules" in p or "baselines" in p or "Debug" in p or p.startswith("lib/sub") or "loop" in p]
    asked.clear()
    left = list(reader.pushFilters([StringStartsWith(("file",), "src/deep/"), StringEndsWith(("file",), ".py"), IsNull(("content",))]))
    assert [type(f) for f in left] == [IsNull]
    assert {r["file"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()} == {"src/deep/b.py"}
    assert set(asked) <= {".gitmodules", "", "src", "src/deep", "src/deep/b.py"}


def test_an_unreadable_file_is_a_row_and_its_excluded_neighbour_is_not(spark, tree):
    """Dangling links can't be opened by anyone, root included."""
    for name in ("src/deep/node_modules/x/gone.js", "src/gone.ts"):
        os.symlink("/nowhere/at/all", tree / name)
    got = {r.file: (r.status, r.content) for r in files.discover(spark, f"file://{tree}", "p").collect()}
    assert got.keys() == KEPT | {"src/gone.ts"} and got["src/gone.ts"] == ("unreadable: FileNotFoundError", None)
    assert files.discover(spark, str(tree), "p").filter("lang = 'python'").count() == 3


def test_large_files_are_rows_and_count(spark, tree):
    got = {r.file: (r.status, r.size, r.content) for r in files.listed(spark, str(tree), mostbytes="12").collect()}
    assert got["src/deep/b.py"] == ("too large", len("// src/deep/b.py"), None) and got["c.py"][0] == "read"
    rows = files.discover(spark, str(tree), "p").withColumn("category", files.category(F.col("file")))
    assert rows.agg(F.sum("size")).first()[0] == sum(os.path.getsize(tree / n) for n in KEPT)


@pytest.mark.parametrize("splits", ["1", "256"])
def test_filters_reach_the_listing(spark, tree, splits):
    rows = files.listed(spark, str(tree), splits=splits)
    plan = rows.filter("file LIKE 'src/%' AND size < 100")._jdf.queryExecution().executedPlan().toString()
    assert "LIKE" not in plan and "StartsWith(file" not in plan.split("BatchScan")[0]  # no filter is left above the scan
    assert {r.file for r in rows.filter("file LIKE 'src/%' AND size < 100").collect()} == {"src/a.ts", "src/deep/b.py"}
    assert {r.file for r in rows.filter(F.col("file").isin("c.py", "lib/own.go") & (F.col("size") > 0)).collect()} == {"c.py", "lib/own.go"}
    rules = listing.Rules(frozenset(), (), filters=(In(("file",), ("a/b.py", "c.py")),))
    assert rules.enters("a") and not rules.enters("b") and rules.takes(listing.Entry("c.py", False))
    bounds = listing.Rules(frozenset(), (), filters=(GreaterThan(("size",), 3), LessThan(("size",), 5), EqualTo(("file",), "x")))
    assert [bounds.takes(listing.Entry("x", False, n)) for n in (3, 4, 5)] == [False, True, False]


def test_an_empty_or_missing_folder(spark, tmp_path):
    assert files.listed(spark, str(tmp_path)).count() == 0
    assert [(r.file, r.status) for r in files.listed(spark, str(tmp_path / "none")).collect()] == [("", "unlisted: FileNotFoundError")]


def test_git_log_over_tasks(spark, tmp_path):
    git = lambda *words, when="2024-01-01T00:00:00Z": subprocess.run(["git", "-C", tmp_path, *words], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when})
    git("init", "-q")
    git("config", "user.name", "ann|b")
    git("config", "user.email", "a@b")
    for k in range(7):
        (tmp_path / f"f{k % 3}.txt").write_text(f"{k}\n" * (k + 1))
        git("add", ".")
        git("commit", "-qm", f"c{k}", when=f"2024-01-0{k + 1}T12:00:00+02:00")
    git("mv", "f0.txt", "g.txt")
    git("commit", "-qm", "moved", when="2024-02-01T00:00:00Z")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    one, many = (sorted(map(tuple, files.git_commits(spark, str(tmp_path), n).collect())) for n in (5000, 2))
    assert one == many and len(one) == 8 and {r[1] for r in one} == {"ann|b"} and "g.txt" in {r[5] for r in one}
    late = files.git_commits(spark, f"file://{tmp_path}", 3).filter("ts >= timestamp'2024-01-05 10:00:00'")
    assert sorted(r.file for r in late.collect()) == ["f0.txt", "f1.txt", "f2.txt", "g.txt"]
    with pytest.raises(Exception, match="no git log"):
        files.git_commits(spark, str(tmp_path / ".git" / "hooks" / "none")).collect()
