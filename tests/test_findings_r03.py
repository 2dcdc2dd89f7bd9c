import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import dependencies
from quarry.plans import repository
from quarry.sources import files, parse

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_headers_hold_over_blocks_of_lines(spark):
    lines = [("a", 1, "abcdef1|ann|2024-01-01T00:00:00"), ("a", 2, "1\t0\tx"), ("a", 35, "1\t0\ty"), ("a", 36, "abcdef2|bob|2024-01-02T00:00:00"), ("a", 37, "1\t0\tx"), ("b", 3, "1\t0\tz"), (None, 1, "abcdef3|cy|2024-01-03T00:00:00"), (None, 50, "1\t0\tw")]
    found = files.git_log(spark.createDataFrame(lines, "source string, n long, value string"), block=10)
    assert {(r.file, r.author) for r in found.collect()} == {("x", "ann"), ("y", "ann"), ("x", "bob"), ("z", None), ("w", "cy")}
    windows = [x for x in plan(found).split("\n") if "Window" in x and "_head" in x]
    assert windows and all("_block" in x for x in windows)


def test_a_task_holds_the_rows_of_few_files():
    n = 1000
    batch = pa.RecordBatch.from_arrays([pa.array(["p"] * n), pa.array([f"f{k}.js" for k in range(n)]), pa.array(["javascript"] * n), pa.array(["export function a() {}\n"] * n)], ["project", "file", "lang", "content"])
    out = list(parse._parse(None)(iter([batch])))
    assert {x for b in out for x in b.column(1).to_pylist()} == {f"f{k}.js" for k in range(n)}
    assert max(b.num_rows for b in out) <= 128 * 4


def test_scripts_are_made_once(spark):
    assert "Window" not in plan(repository._modules(spark, SF))
    assert "Window" not in plan(repository.dead_functions(spark, SF)) and "MapInArrow" not in plan(repository.dead_functions(spark, SF))


def test_advisories_are_dealt_by_name(spark):
    found = spark.range(9).select(F.col("id").cast("string").alias("name"), F.lit("CVE-2020-1").alias("cve"))
    assert plan(dependencies.best_advisory(found, found)).count("REPARTITION_BY_NUM") >= 2
