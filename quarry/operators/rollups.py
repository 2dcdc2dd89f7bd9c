"""Rollups of a whole scan: what the reports and gates show, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S


def largest(rows: DataFrame, size: str, *ties: str, n: int | None = None) -> DataFrame:
    """The largest first, all or the first ``n``."""
    ordered = rows.orderBy(F.desc(size), *ties)
    return ordered if n is None else ordered.limit(n)


def waste_breakdown(rows: DataFrame) -> DataFrame:
    """part, bytes, percent of wasted bytes (part, size): unused dependencies, dead code, unused and unoptimised assets."""
    per = rows.groupBy("part").agg(F.sum("size").cast("long").alias("bytes"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("bytes").alias("_all")))).select("part", "bytes", F.round(100.0 * F.col("bytes") / F.col("_all"), 2).alias("percent"))


def ci_metrics(scan: DataFrame) -> DataFrame:
    """One row of findings (kind, severity, detail, size, percent): the figures that gates read.

    Kinds: vulnerability (detail: exploitable or not), unused-dependency, dead-file, outdated
    (detail: update type, or security for one with a fix), licence (detail: its class).
    """
    n = lambda cond: F.count_if(cond)
    k, s, d = F.col("kind"), F.col("severity"), F.col("detail")
    wasted = F.sum(F.when(k.isin("unused-dependency", "dead-file"), F.col("size")).otherwise(0))
    return scan.agg(
        n((k == "vulnerability") & (s == "critical")).alias("critical_vulnerabilities"), n((k == "vulnerability") & (s == "high")).alias("high_vulnerabilities"),
        n((k == "vulnerability") & (d == "exploitable")).alias("exploitable"), n(k == "unused-dependency").alias("unused_dependencies"), n(k == "dead-file").alias("dead_files"),
        F.round(F.coalesce(wasted, F.lit(0)) / float(1 << 20), 2).alias("waste_mb"), n((k == "outdated") & (d == "major")).alias("outdated_major"), n((k == "outdated") & (d == "security")).alias("outdated_critical"),
        (n((k == "licence") & d.isin("copyleft", "restrictive")) == 0).alias("licence_compliant"),
    )


def with_resolutions(exports: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Exports (file, name) with ``resolved``: whether someone has settled them (file, name)."""
    done = resolutions.select("file", "name", F.lit(True).alias("resolved")).distinct()
    return exports.join(done, ["file", "name"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def learned_stats(learned: DataFrame) -> DataFrame:
    """One row of learned entries (kind, status): false positives, new and promoted patterns, changes."""
    kind = lambda k: F.count_if(F.col("kind") == k)
    promoted = F.count_if((F.col("kind") == "pattern") & (F.col("status") == "promoted"))
    return learned.agg(kind("false-positive").alias("false_positives"), kind("pattern").alias("new_patterns"), promoted.alias("promoted_patterns"), kind("change").alias("changes"))


def fix_rollup(fixes: DataFrame) -> DataFrame:
    """module, issues, high, medium, low, automatic, savings of possible fixes (module, confidence, automatic, size)."""
    sure = lambda c: F.count_if(F.col("confidence") == c).alias(c.lower())
    return fixes.groupBy("module").agg(
        F.count(F.lit(1)).alias("issues"), sure("HIGH"), sure("MEDIUM"), sure("LOW"), F.count_if("automatic").alias("automatic"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("savings")
    )


def selected_fixes(dead: DataFrame, least: float = 0.0) -> DataFrame:
    """Dead files (file, size, confidence, second_confidence) sure enough to take out; the second opinion counts before the first, none at all as sure."""
    sure = F.coalesce("second_confidence", "confidence", F.lit(1.0))
    return dead.filter(sure >= least).select("file", "size", F.lit("dead-code").alias("type"))


#: The tables of a knowledge base, and the columns that each row must have.
KNOWLEDGE = {"language": ("name", "extensions"), "framework": ("name", "detect", "entry_patterns"), "pattern": ("id", "regex", "severity")}


def invalid_knowledge(rows: DataFrame) -> DataFrame:
    """kind, name, missing: entries (kind, name, fields map) of a knowledge base that lack what their kind needs, or are of no kind."""
    needed = F.create_map(*(x for k, v in KNOWLEDGE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    lacking = F.filter(F.coalesce(F.try_element_at(needed, F.col("kind")), F.array(F.lit("kind"))), lambda f: F.coalesce(F.try_element_at("fields", f), F.lit("")) == "")
    return rows.withColumn("missing", lacking).filter(F.size("missing") > 0).select("kind", "name", "missing")


def esg_table(scans: DataFrame) -> DataFrame:
    """project, scans, first, last, change, avoided of scans (project, ts, id, grams, fixed_bytes), the highest emissions first."""
    at = F.struct("ts", "id")
    per = scans.groupBy("project").agg(F.count(F.lit(1)).alias("scans"), F.min_by("grams", at).alias("first"), F.max_by("grams", at).alias("last"), F.sum("fixed_bytes").alias("_fixed"))
    change = F.when(F.col("first") > 0, F.round((F.col("last") - F.col("first")) / F.col("first") * 100, 1))
    return per.select("project", "scans", "first", "last", change.alias("change"), F.round(S.avoided_grams(F.col("_fixed")), 4).alias("avoided")).orderBy(F.desc("last"), "project")
