import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.sinks import document, reports


def test_a_million_findings_are_one_valid_file(spark, tmp_path):
    n = 1_000_000
    rows = spark.range(0, n, 1, 8).select(
        F.concat(F.lit("r"), F.col("id") % 7).alias("rule"), F.when(F.col("id") % 2 == 0, "high").otherwise("low").alias("severity"), F.lit('a "b"/é.js').alias("file"), F.col("id").alias("line"), F.lit("x\ny").alias("message")
    )
    path = tmp_path / "report.sarif"
    document.write_sarif(rows, f"file://{path}", 'quarry "scan"')
    told = json.loads(path.read_text())
    run = told["runs"][0]
    assert told["version"] == "2.1.0" and run["tool"]["driver"]["name"] == 'quarry "scan"' and [r["id"] for r in run["tool"]["driver"]["rules"]] == [f"r{k}" for k in range(7)]
    assert len(run["results"]) == n and [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"][:3]] == [1, 1, 2]
    assert run["results"][-1]["ruleId"] == f"r{(n - 1) % 7}" and os.listdir(tmp_path) == ["report.sarif"]


def test_documents_equal_the_one_row_reports(spark, tmp_path):
    found = spark.createDataFrame([("a", "high", "f.js", 3, "m"), ("b", "low", "g.js", None, None)], "rule string, severity string, file string, line int, message string")
    document.write_sarif(found.repartition(3), str(tmp_path / "s.json"), "quarry")
    got, want = json.loads((tmp_path / "s.json").read_text()), json.loads(reports.sarif(found, "quarry").first()["sarif"])
    key = lambda r: r["ruleId"]
    assert sorted(got["runs"][0]["results"], key=key) == sorted(want["runs"][0]["results"], key=key) and got["runs"][0]["tool"] == want["runs"][0]["tool"]
    summary, rows = spark.createDataFrame([(2, None)], "total int, worst string"), found.select("rule", "line")
    path = tmp_path / "r.json"
    path.write_text("old")
    document.write_json_report(str(path), summary, findings=rows, none=rows.limit(0))
    got = json.loads(path.read_text())
    assert got["summary"] == {"total": 2, "worst": None} and sorted(got["findings"], key=str) == [{"rule": "a", "line": 3}, {"rule": "b", "line": None}] and got["none"] == []


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text("old")
    bad = spark.range(0, 100, 1, 4).select(F.lit(0).alias("section"), F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("line"))
    with pytest.raises(Exception, match="no"):
        document.write_document(bad, str(path), ["[", 0, "]"])
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["r.json"]
