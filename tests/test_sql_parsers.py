import pytest

from quarry.sources import parse, sql

FILES = [("p", "a.js", "javascript", "import x from './b'\nexport function f() {\n}\n"), ("p", "b.py", "python", "def g(): pass\nprint 1\n"), ("q", "c.lang", "mine", "one two"), ("q", "d.lang", "mine", "bad"), ("q", "e.js", "javascript", None)]


def words(lang, text):
    if text == "bad":
        raise ValueError("no words")
    return [{"relation": "function", "type": lang, "name": w, "line": k + 1, "specifiers": [("a", "b", "named")]} for k, w in enumerate(text.split())]


def test_a_users_parser_called_from_sql(spark):
    frame = spark.createDataFrame([(c, p, f, lang, 1) for p, f, lang, c in FILES], "content string, project string, file string, lang string, other int").repartition(3)
    frame.createOrReplaceTempView("some_files")
    sql.register(spark, "parse_mine", {"mine": words})
    got = spark.sql("SELECT * FROM parse_mine(TABLE(some_files) PARTITION BY (project, file))")
    want = parse.parsed(frame, {"mine": words})
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.file, r.type, r.name) for r in got.filter("relation = 'error'").collect()} == {("d.lang", "ValueError", "no words"), ("b.py", "SyntaxError", "Missing parentheses in call to 'print'. Did you mean print(...)? (<unknown>, line 2)")}
    counted = spark.sql("SELECT project, count_if(relation = 'function') AS n FROM parse_mine(TABLE(some_files) PARTITION BY (project, file)) GROUP BY project")
    assert {(r.project, r.n) for r in counted.collect()} == {("p", 2), ("q", 2)}


def test_what_it_is_given_is_checked(spark):
    sql.register(spark)
    spark.range(1).createOrReplaceTempView("no_files")
    with pytest.raises(Exception, match="lacks project, file, lang, content"):
        spark.sql("SELECT * FROM parse_code(TABLE(no_files) PARTITION BY id)").collect()
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM parse_code(1)").collect()
