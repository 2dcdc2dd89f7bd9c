"""Reports as rows of text: JSON, SARIF, CSV; and the scan store with latest-wins upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(summary: DataFrame, **parts: DataFrame) -> DataFrame:
    """part, n, line: the summary and each row of each part as a JSON line; ``json_report`` wraps them.

    Nothing is gathered: a report of any size is written as it is, in as many files as it takes.
    """
    rows = lambda name, df: df.select(F.lit(name).alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    out = rows("summary", summary)
    for name, df in parts.items():
        out = out.unionByName(rows(name, df))
    return out


def json_report(summary: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row ``report``: the summary's fields and each part as an array, in a fixed order.

    One row holds it all, so it is for reports that one reader can take; ``json_lines`` is for others.
    """
    out = summary.select(F.struct("*").alias("summary"))
    for name, rows in parts.items():
        out = out.crossJoin(rows.agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name)))
    return out.select(F.to_json(F.struct("*")).alias("report"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """rule, result: each finding as a SARIF result in JSON.

    ``findings``: rule, severity, file, line, message, and where there are any: verdict, a second
    opinion that sets the level (a false alarm is none, a sure one an error), and kind, which is
    function or export for what is dead in a live file.
    """
    severity = F.lower("severity")
    level = F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")
    if "kind" in findings.columns:
        level = F.when(F.col("kind").isin("function", "export"), "warning").otherwise(level)
    if "verdict" in findings.columns:
        level = F.when(F.col("verdict") == "false-positive", "none").when(F.col("verdict") == "confirmed", "error").otherwise(level)
    region = F.struct(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("rule", level.alias("level"), F.to_json(result).alias("result"))


def sarif(findings: DataFrame, tool: str, version: str = "1.0") -> DataFrame:
    """One row ``sarif`` of findings; ``sarif_results`` gives its results as rows, for more than one reader can take."""
    results = sarif_results(findings)
    rules = F.array_join(F.transform(F.array_sort(F.collect_set("rule")), lambda r: F.to_json(F.struct(r.alias("id")))), ",")
    told = F.array_join(F.array_sort(F.collect_list("result")), ",")
    head = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":'), F.to_json(F.struct(F.lit(tool).alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.lit(tool).alias("n")))) - 6))
    return results.agg(F.concat(head, F.lit(f',"version":"{version}","rules":['), rules, F.lit(']}},"results":['), told, F.lit("]}]}")).alias("sarif"))


def markdown(rows: DataFrame, title: str, order: list) -> DataFrame:
    """n, line: a table of ``rows`` in Markdown, under its title; cells have no bars or line breaks."""
    from pyspark.sql import Window

    cell = lambda c: F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"[|\r\n]+", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, rows.columns)), F.lit(" |"))
    body = rows.select((F.row_number().over(Window.orderBy(*order)) + 4).alias("n"), line.alias("line"))
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
    return body.sparkSession.createDataFrame(list(enumerate(head, 1)), "n int, line string").unionByName(body)


def csv_lines(rows: DataFrame) -> DataFrame:
    """line: each row as a CSV line; a cell with a comma, quote or line break is quoted, and its quotes doubled."""
    def cell(c: str):
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return rows.select(F.concat_ws(",", *map(cell, rows.columns)).alias("line"))


def with_exports(issues: DataFrame) -> DataFrame:
    """One row for each export of an issue, or one where it has none."""
    return issues.withColumn("export", F.explode_outer("exports")).drop("exports")


def action_csv(issues: DataFrame, path: str) -> None:
    """One line for each export of an issue, or one where it has none."""
    with_exports(issues).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def by_project_json(scans: DataFrame, path: str) -> None:
    scans.write.mode("overwrite").partitionBy("project").json(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Append to a store and read it so that the last written row of each key wins."""
    from quarry.operators.history import latest

    rows.write.mode("append").parquet(path)
    return latest(spark.read.parquet(path), keys, [F.desc(stamp)])


def insert_missing(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the store lacks: what an insert that ignores conflicts would add."""
    return rows.dropDuplicates(keys).join(store.select(*keys).distinct(), keys, "left_anti")


def tree(files: DataFrame, depth: int | None = None) -> DataFrame:
    """Directories and files to a depth, directories first at each place."""
    pieces = F.split("file", "/")
    each = files.select("project", F.posexplode(pieces).alias("at", "name"), pieces.alias("p"), "size")
    node = each.groupBy("project", F.array_join(F.slice("p", F.lit(1), F.col("at") + 1), "/").alias("path"), "at", "name").agg(
        F.max(F.size("p") - 1 > F.col("at")).alias("is_dir"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("files")
    )
    kept = node if depth is None else node.filter(F.col("at") < depth)
    return kept.orderBy("project", "at", F.desc("is_dir"), "path")
