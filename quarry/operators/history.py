"""Repository and scan history: commit buckets, decay, differences between scans, reporting periods."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S

BUCKETS = (30, 90, 180, 365)


def commit_buckets(commits: DataFrame, as_of: Column, days: tuple[int, ...] = BUCKETS, files: DataFrame | None = None) -> DataFrame:
    """Per file (file, author, ts): commits in each look-back window, authors ever and in the second window, first and last.

    With ``files`` there is a row for each of them, also for those without commits, and for no other.
    """
    if files is not None:
        found = commit_buckets(commits, as_of, days)
        counts = [c for c in found.columns if c.startswith(("commits_", "contributors_"))]
        return files.select("file").join(found, "file", "left").fillna(0, counts)
    within = lambda n: F.col("ts") >= as_of - F.make_dt_interval(F.lit(n))
    return commits.filter(F.col("ts") <= as_of).groupBy("file").agg(
        *(F.count_if(within(n)).alias(f"commits_{n}d") for n in days),
        F.countDistinct("author").alias("contributors_all"),
        F.countDistinct(F.when(within(days[1]), F.col("author"))).alias(f"contributors_{days[1]}d"),
        F.min("ts").alias("first_commit"),
        F.max("ts").alias("last_commit"),
    )


#: Logarithm of a sketch's registers: distinct authors are within about 1.04 / 2^(LG_K / 2), 0.8 %, as standard error; up to some 1,500 all but exact.
LG_K = 14


def day_partials(commits: DataFrame) -> DataFrame:
    """file, day, commits, authors (a sketch), first_commit, last_commit: what of a day's commits (file, author, ts) later questions need.

    Partials of one file and day merge like those of several days, so a day may come in parts.
    """
    return commits.filter("file IS NOT NULL AND ts IS NOT NULL").groupBy("file", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("commits"), F.hll_sketch_agg("author", LG_K).alias("authors"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit")
    )


def keep_days(commits: DataFrame, path: str) -> None:
    """Write the partials of the days in ``commits``, a folder for each; a day that is there already is replaced, others are not touched."""
    out = day_partials(commits)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def kept_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def buckets_of_days(partials: DataFrame, upto: Column, days: tuple[int, ...] = BUCKETS) -> DataFrame:
    """``commit_buckets`` from partials: windows are whole days that end with the day ``upto``; counts are exact, contributors estimates.

    Days after ``upto`` are left out by their folder's name.
    """
    within = lambda n: F.col("day") > F.date_sub(upto, n)
    estimate = lambda sketch: F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0).cast("long"))
    return partials.filter(F.col("day") <= upto).groupBy("file").agg(
        *(F.coalesce(F.sum(F.when(within(n), F.col("commits"))), F.lit(0).cast("long")).alias(f"commits_{n}d") for n in days),
        estimate(F.hll_union_agg("authors")).alias("contributors_all"),
        estimate(F.hll_union_agg(F.when(within(days[1]), F.col("authors")))).alias(f"contributors_{days[1]}d"),
        F.min("first_commit").alias("first_commit"),
        F.max("last_commit").alias("last_commit"),
    )


SIGNALS = ("velocity", "imports", "contributors", "staleness", "mtime", "fragility", "exports")
#: Extensions of source files; others are expected to be stable.
SOURCE_EXTENSIONS = (
    "js ts jsx tsx mjs cjs py pyx pyi go java kt kts scala rb erb rs php cs fs fsx c h cpp hpp cc hh swift m mm dart ex exs hs lhs lua pl pm r clj cljs cljc "
    "ml mli jl zig nim erl hrl groovy gradle cr v sh bash zsh ps1 cob cbl f90 f95 f03 vb svelte vue sol move"
).split()


def is_source(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*SOURCE_EXTENSIONS)


def with_previous_importers(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Adds ``previous_importers``: what the scan before had for the same file, null where it had none."""
    before = previous.groupBy("file").agg(F.max("importer_count").alias("previous_importers"))
    return current.join(before, "file", "left")


def decay(files: DataFrame, as_of: Column) -> DataFrame:
    """Signals and total of each file's decline.

    ``files``: file, commits_30d, commits_90d, commits_365d, contributors_all, contributors_90d,
    last_commit, mtime, importer_count, previous_importers, export_total, export_dead.
    """
    c = F.col
    age = lambda ts: (F.unix_timestamp(as_of) - F.unix_timestamp(c(ts))) / 86400.0
    stale = S.staleness(age("last_commit"))
    signals = files.select(
        "file",
        S.velocity_decline(c("commits_30d"), c("commits_90d"), c("commits_365d")).alias("velocity"),
        S.import_decline(c("importer_count"), c("previous_importers")).alias("imports"),
        S.contributor_withdrawal(c("contributors_90d"), c("contributors_all"), c("commits_90d")).alias("contributors"),
        stale.alias("staleness"),
        S.mtime_staleness(age("mtime"), stale).alias("mtime"),
        S.import_fragility(c("importer_count")).alias("fragility"),
        S.dead_export_share(c("export_dead"), c("export_total")).alias("exports"),
    )
    scored = signals.withColumn("score", F.round(sum((F.col(s) for s in SIGNALS), F.lit(0.0)), 1))
    return scored.withColumn("risk", S.decay_level(F.col("score")))


def decay_candidates(scored: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """Live source files at any risk, the highest score first."""
    rows = scored.filter((F.col("risk") != "none") & is_source(F.col("file")))
    if dead is not None:
        rows = rows.join(dead.select("file"), "file", "left_anti")
    return rows.orderBy(F.desc("score"), "file")


def decay_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk").agg(F.count(F.lit(1)).alias("files"))


def scan_diff(previous: DataFrame, current: DataFrame, *key: str) -> DataFrame:
    """Every issue of either scan with its status: resolved, open or new. Other columns are the current's where it has one."""
    p = previous.select(*key, F.lit(True).alias("_before"), F.struct(*(c for c in previous.columns if c not in key)).alias("_p"))
    n = current.select(*key, F.lit(True).alias("_now"), F.struct(*(c for c in current.columns if c not in key)).alias("_n"))
    both = p.join(n, list(key), "full_outer")
    status = F.when(F.col("_now").isNull(), "resolved").when(F.col("_before").isNull(), "new").otherwise("open")
    return both.select(*key, status.alias("status"), F.col("_p").alias("previous"), F.col("_n").alias("current"))


def days_open(first_seen: Column, as_of: Column) -> Column:
    return F.ceil((F.unix_timestamp(as_of) - F.unix_timestamp(first_seen)) / 86400.0)


def with_previous(scans: DataFrame, project: str, order: list, value: str) -> DataFrame:
    """Adds the value of the project's scan before, and how much it fell since."""
    before = F.lag(value).over(Window.partitionBy(project).orderBy(*order))
    return scans.withColumn("previous", before).withColumn("fixed", F.greatest(F.lit(0), F.col("previous") - F.col(value)))


def trend(first: Column, last: Column) -> Column:
    """Percent change; null where there is nothing to compare with."""
    return F.when(first > 0, F.round((last - first) / first * 100, 1))


def trend_sign(percent: Column, band: float = 2.0) -> Column:
    return F.when(percent.isNull(), "flat").when(percent > band, "up").when(percent < -band, "down").otherwise("flat")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def period(preset: str, as_of: Column) -> tuple[Column, Column]:
    """Start and end of a reporting period: 30d, 90d, quarter, last-quarter, year, last-year, or one quarter, as in 2024-Q3."""
    quarter, year = F.date_trunc("quarter", as_of), F.date_trunc("year", as_of)
    named = re.fullmatch(r"(\d{4})-?Q([1-4])", preset, re.I)
    if named:
        first = F.make_date(F.lit(int(named[1])), F.lit(3 * int(named[2]) - 2), F.lit(1)).cast("timestamp")
        return first, F.add_months(first, 3).cast("timestamp")
    bounds = {
        "30d": (as_of - F.make_dt_interval(F.lit(30)), as_of),
        "90d": (as_of - F.make_dt_interval(F.lit(90)), as_of),
        "quarter": (quarter, as_of),
        "last-quarter": (F.add_months(quarter, -3).cast("timestamp"), quarter),
        "year": (year, as_of),
        "last-year": (F.add_months(year, -12).cast("timestamp"), year),
    }
    return bounds[preset]


def custom_range(first_day: str, last_day: str) -> tuple[Column, Column]:
    """From the start of one day to the end of another, both included; in either order."""
    a, b = sorted((first_day, last_day))
    return F.to_timestamp(F.lit(a)), F.date_add(F.to_date(F.lit(b)), 1).cast("timestamp")


def within(rows: DataFrame, ts: str, bounds: tuple[Column, Column]) -> DataFrame:
    return rows.filter((F.col(ts) >= bounds[0]) & (F.col(ts) < bounds[1]))


def by_month(scans: DataFrame) -> DataFrame:
    """month, scans, waste, projects of scans (project, ts, waste)."""
    return scans.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("scans"), F.sum("waste").alias("waste"), F.countDistinct("project").alias("projects"))


def recent(scans: DataFrame, n: int, order: list) -> DataFrame:
    return scans.orderBy(*order).limit(n)


def project_stats(scans: DataFrame, value: str) -> DataFrame:
    """project, scans, total, highest of scans (project, ``value``)."""
    return scans.groupBy("project").agg(F.count(F.lit(1)).alias("scans"), F.sum(value).alias("total"), F.max(value).alias("highest"))


def percent_of_total(rows: DataFrame, key: str) -> DataFrame:
    """``key``, n, percent: one row for each value, and its share of all rows."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("_all")))).withColumn("percent", F.round(100.0 * F.col("n") / F.col("_all"), 4)).drop("_all")


def scans_of_projects(scans: DataFrame, projects: DataFrame) -> DataFrame:
    """Each scan once, with its project's row where there is one: a left join without repeats."""
    return scans.join(projects, "project", "left").distinct()
