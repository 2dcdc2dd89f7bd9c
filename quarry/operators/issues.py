"""Issues of a scan as one list, its summaries, and the gates that read them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S

COLUMNS = ("id", "severity", "category", "title", "file", "size", "effort")


def branch(rows: DataFrame, category: str, key: Column, severity: Column, title: Column, file: Column, size: Column, effort: str) -> DataFrame:
    """One kind of finding as issues."""
    return rows.select(
        S.issue_id(F.lit(category), key).alias("id"), severity.alias("severity"), F.lit(category).alias("category"), title.alias("title"), file.alias("file"),
        size.cast("long").alias("size"), F.lit(effort).alias("effort"),
    )


def action_list(*branches: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def worst_first(issues: DataFrame) -> DataFrame:
    return issues.orderBy(S.severity_rank(F.col("severity")), "category", "id")


def quick_wins(issues: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` that take little effort."""
    return issues.filter("effort IN ('trivial', 'easy', 'low')").orderBy(S.severity_rank(F.col("severity")), F.desc("size"), "id").limit(n)


def next_actions(issues: DataFrame, critical: int = 3, high: int = 2, most: int = 5) -> DataFrame:
    """The first critical and high issues, at most ``most``."""
    n = F.row_number().over(Window.partitionBy("severity").orderBy(F.desc("size"), "id"))
    chosen = issues.withColumn("_n", n).filter(((F.col("severity") == "critical") & (F.col("_n") <= critical)) | ((F.col("severity") == "high") & (F.col("_n") <= high)))
    return chosen.drop("_n").orderBy(S.severity_rank(F.col("severity")), F.desc("size"), "id").limit(most)


def by_severity(issues: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return issues.agg(F.count(F.lit(1)).alias("total"), *(count(s) for s in ("critical", "high", "medium", "low")))


def thresholds(metrics: DataFrame, limits: dict[str, float | None]) -> DataFrame:
    """check, actual, allowed, passed of a one-row table; a limit of None is not checked."""
    rows = [
        F.struct(F.lit(name).alias("check"), F.col(name).cast("double").alias("actual"), F.lit(float(limit)).alias("allowed"))
        for name, limit in limits.items()
        if limit is not None
    ]
    each = metrics.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    return each.withColumn("passed", F.col("actual") <= F.col("allowed"))


def commit_state(score: Column) -> Column:
    return F.when(score >= 70, "success").when(score >= 40, "pending").otherwise("failure")


def apply_rules(rules, **tables: DataFrame) -> DataFrame:
    """Findings of every rule, a function from tables to a findings table, one below the other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (rule(**tables) for rule in rules))


def without_learned(findings: DataFrame, false_positives: DataFrame, *key: str) -> DataFrame:
    """Findings that nobody has marked as false."""
    return findings.join(false_positives.select(*key).distinct(), list(key), "left_anti")
