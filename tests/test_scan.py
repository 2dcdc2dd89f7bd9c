import pytest

from quarry.plans.scan import analyse
from tests.fixtures_repos import EXPECTED, FILES


@pytest.fixture(scope="module")
def scan(spark):
    rows = [(project, file, content) for project, files in FILES.items() for file, content in files.items()]
    found = analyse(spark.createDataFrame(rows, "project string, file string, content string"))
    of = lambda frame, *columns: [tuple(r[c] for c in columns) for r in frame.collect()]
    exports = [(r.project, r.file, n) for r in found.dead_exports.collect() for n in r.dead_names]
    return {"files": of(found.dead_files, "project", "node"), "functions": of(found.dead_functions, "project", "file", "name"), "exports": exports, "edges": of(found.edges, "project", "src", "dst")}


@pytest.mark.parametrize("project", sorted(FILES))
def test_repositories(scan, project):
    want = EXPECTED[project]
    own = {k: [r[1:] for r in rows if r[0] == project] for k, rows in scan.items()}
    assert {(f,) for f in want.get("dead_files", [])} <= set(own["files"])
    assert not (want.get("no_dead_files") and own["files"])
    assert set(want.get("dead_functions", [])) <= set(own["functions"])
    assert not {n for _, n in own["functions"]} & set(want.get("live_functions", []))
    assert set(want.get("dead_exports", [])) <= set(own["exports"])
    assert not {n for _, n in own["exports"]} & set(want.get("live_exports", []))


def test_nothing_else_is_reported(scan):
    assert sorted(scan["files"]) == [("js-basic", "src/orphan.js"), ("js-guards", "src/globals.js")]
    assert sorted(scan["functions"]) == [
        ("go-functions", "main.go", "deadHelper"), ("js-basic", "src/used.js", "deadArrow"), ("js-basic", "src/used.js", "deadLocal"),
        ("python-methods", "app/worker.py", "_dead_helper"), ("ts-private", "src/service.ts", "#deadEs"), ("ts-private", "src/service.ts", "deadTs"),
    ]


def test_files_that_see_each_other(spark):
    """A Go test reaches its package and the other way round; packages join over source roots, directories without a package don't."""
    rows = [
        ("a/x_test.go", "package a", "go"), ("a/y.go", "package a", "go"), ("a/old_z.go", "package a", "go"), ("b/y.go", "package b", "go"),
        ("one/src/main/java/p/A.java", "package p;", "java"), ("two/B.kt", "\n  package p\n", "kotlin"), ("three/src/main/kotlin/p/C.kt", "class C", "kotlin"), ("x/D.java", "class D", "java"), ("x/E.java", "class E", "java"),
        ("p/LegacyF.java", "package p;", "java"),
    ]
    from quarry.operators import graph
    from quarry.plans.scan import implicit_edges

    edges = implicit_edges(spark.createDataFrame([("q", *r) for r in rows], "project string, file string, content string, lang string"))
    reach = lambda *starts: {r.node for r in graph.reachable(edges, spark.createDataFrame([("q", s) for s in starts], "project string, node string")).collect() if not r.node.startswith("scope:")}
    assert reach("a/x_test.go") == reach("a/y.go") == {"a/x_test.go", "a/y.go"}
    assert reach("two/B.kt") == {"two/B.kt", "one/src/main/java/p/A.java", "three/src/main/kotlin/p/C.kt"} and reach("x/D.java") == {"x/D.java"}
