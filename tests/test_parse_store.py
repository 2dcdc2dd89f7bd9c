import pytest

from quarry.sources import parse, parse_store

FILE = "project string, file string, lang string, content string"
FILES = [
    ("p", "src/a.js", "javascript", "import x from './b'\nexport function f() {\n}\n"), ("p", "src/deep/b.js", "javascript", "export const g = () => 1\n"), ("p", "src/deep/copy.js", "javascript", "export const g = () => 1\n"),
    ("p", "c.vue", "javascript", "<script>\nfunction h() {}\n</script>"), ("p", "c.js", "javascript", "<script>\nfunction h() {}\n</script>"), ("q", "lib/d.py", "python", "def k(): pass\n"), ("q", "lib/empty.py", "python", ""), ("q", "none.py", "python", None),
]


def broken(lang, text):
    raise ValueError(text)


BROKEN = {"javascript": broken, "python": broken}


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    parse_store.add_missing(spark.createDataFrame(FILES, FILE), path)
    return path


def test_kept_rows_are_those_of_the_readers(spark, store):
    """A second run has readers that fail on everything, and none of them is asked."""
    frame = spark.createDataFrame(FILES, FILE)
    got, want = parse_store.parsed(frame, store, BROKEN), parse.parsed(frame)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_change_parses_one_file_and_renames_parse_none(spark, store):
    moved = [("r", "other/" + f.replace("a.js", "z.js"), lang, c) for _, f, lang, c in FILES]
    got = parse_store.parsed(spark.createDataFrame(moved, FILE), store, BROKEN)
    assert got.filter("relation = 'error'").count() == 0 and {r.file for r in got.collect()} >= {"other/src/z.js", "other/src/deep/copy.js"}
    edited = [(p, f, lang, c + "// more" if f == "src/a.js" else c) for p, f, lang, c in FILES]
    assert [(r.file, r.name) for r in parse_store.parsed(spark.createDataFrame(edited, FILE), store, BROKEN).filter("relation = 'error'").collect()] == [("src/a.js", FILES[0][3] + "// more")]
    twice = [("p", f"n{k}.js", "javascript", "new text") for k in range(5)]
    calls = []
    parse_store.add_missing(spark.createDataFrame(twice, FILE), store, {"javascript": lambda lang, text: calls.append(text) or []})
    assert spark.read.parquet(store).groupBy("hash").count().filter("count > 1").isEmpty()


def test_equal_subtrees_are_skipped(spark):
    frame = lambda rows: parse_store.hashed(spark.createDataFrame(rows, FILE))
    before = parse_store.directories(frame(FILES))
    assert {(r.project, r.directory) for r in before.collect()} == {("p", "."), ("p", "src"), ("p", "src/deep"), ("q", "."), ("q", "lib")}
    assert parse_store.changed(before, parse_store.directories(frame(FILES[::-1]))).count() == 0
    edited = [(p, f, lang, "changed" if f == "src/deep/b.js" else c) for p, f, lang, c in FILES]
    now = frame(edited)
    moved = parse_store.changed(before, parse_store.directories(now))
    assert {(r.project, r.directory) for r in moved.collect()} == {("p", "."), ("p", "src"), ("p", "src/deep")}
    assert {r.file for r in parse_store.in_changed(now, moved).collect()} == {"src/a.js", "src/deep/b.js", "src/deep/copy.js", "c.vue", "c.js"}
    renamed = [(p, f.replace("lib/d", "lib/e"), lang, c) for p, f, lang, c in FILES]
    assert {(r.project, r.directory) for r in parse_store.changed(before, parse_store.directories(frame(renamed))).collect()} == {("q", "."), ("q", "lib")}
    assert parse_store.directories(frame(FILES[:0] or FILES).limit(0)).count() == 0
