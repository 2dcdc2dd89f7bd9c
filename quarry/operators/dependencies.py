"""Declared packages against used ones, advisories, releases and licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.shared import tasks_for


def unused(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Runtime dependencies (project, name, declared_in, ...) that no import names."""
    return declared.filter("declared_in = 'dependencies'").join(used.select("project", "name"), ["project", "name"], "left_anti")


def dependents(edges: DataFrame) -> DataFrame:
    """Who requires each package directly, from flattened lockfile edges (project, requirer, name)."""
    return edges.groupBy("project", "name").agg(F.array_sort(F.collect_set("requirer")).alias("dependents"), F.countDistinct("requirer").alias("n_dependents"))


def heavy(packages: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Packages with lighter alternatives (name, alternative, saving)."""
    return packages.join(alternatives, "name").orderBy(F.desc("size_bytes"), "name")


def top_share(packages: DataFrame, size: str, key: str, n: int = 10) -> DataFrame:
    """Share of the total that the ``n`` largest hold. Sums by rank only; ties fall to the smaller key."""
    top = packages.select(key, size).orderBy(F.desc(size), key).limit(n).agg(F.sum(size).alias("top"), F.count(F.lit(1)).alias("n_top"))
    return packages.agg(F.sum(size).alias("total")).crossJoin(top).withColumn("share", F.round(F.try_divide("top", "total"), 6))


def versions_behind(installed: DataFrame, releases: DataFrame) -> DataFrame:
    """How many releases, and days, each installed version is behind; ``releases``: name, version, and released where it is known."""
    dated = releases if "released" in releases.columns else releases.withColumn("released", F.lit(None).cast("timestamp"))
    stable = dated.filter(~F.col("version").contains("-")).groupBy("name", "version").agg(F.min("released").alias("released")).withColumn("v", S.version(F.col("version")))
    ranked = stable.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("v", "version")))
    last = ranked.groupBy("name").agg(F.max("rank").alias("last_rank"), F.max_by("version", "rank").alias("latest"), F.max_by("released", "rank").alias("latest_released"))
    own = installed.join(ranked.select("name", "version", "rank", F.col("released").alias("current_released")), ["name", "version"], "left").join(last, "name")
    behind = F.coalesce(F.col("last_rank") - F.col("rank"), S.versions_behind_estimate(F.col("version"), F.col("latest")))
    days = S.days_behind(F.col("current_released"), F.col("latest_released"))
    return own.withColumns({"behind": behind, "days_behind": days, "update_type": S.update_type(F.col("version"), F.col("latest"))}).drop("rank", "last_rank", "current_released", "latest_released")


def outdated_summary(packages: DataFrame) -> DataFrame:
    """One row of packages (update_type, deprecated, maintained, cves): how many of each kind."""
    kind = lambda k: F.count_if(F.col("update_type") == k).alias(k)
    return packages.agg(
        F.count(F.lit(1)).alias("total"), kind("major"), kind("minor"), kind("patch"), F.count_if("deprecated").alias("deprecated"), F.count_if(~F.col("maintained")).alias("unmaintained"),
        F.count_if(F.col("cves") > 0).alias("with_security_fixes"),
    )


def by_priority(packages: DataFrame) -> DataFrame:
    """Packages with security fixes first, the most of them on top, then by the priority of what to do."""
    return packages.orderBy(F.when(F.col("cves") > 0, 0).otherwise(1), F.desc("cves"), S.severity_rank(F.col("priority")), "name")


def quick_updates(packages: DataFrame, n: int = 5) -> DataFrame:
    """kind, name: the first few of each kind of easy update. ``packages``: name, update_type, effort, cves, deprecated, breaking."""
    easy = (F.col("effort") == "low") & (F.col("cves") == 0) & ~F.col("deprecated")
    kinds = F.array(
        F.when(F.col("cves") > 0, "security-updates"), F.when(easy & (F.col("update_type") == "patch"), "patch-updates"),
        F.when(easy & (F.col("update_type") == "minor") & ~F.col("breaking"), "minor-updates"), F.when(F.col("deprecated"), "replace-deprecated"),
    )
    each = packages.withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("cves"), "name"))
    return each.withColumn("_n", place).filter((F.col("_n") <= n) | (F.col("kind") == "replace-deprecated")).select("kind", "name")


def vulnerability_summary(found: DataFrame) -> DataFrame:
    """One row of vulnerabilities (severity, risk): by severity, really exploitable ones, and those that only an audit flags."""
    of = lambda s: F.count_if(F.lower("severity") == s).alias(s)
    return found.agg(F.count(F.lit(1)).alias("total"), *map(of, ("critical", "high", "medium", "low")), F.count_if(F.col("risk") == "high").alias("exploitable"), F.count_if(F.col("risk") == "low").alias("audit_only"))


def vulnerabilities_by_package(found: DataFrame) -> DataFrame:
    return found.groupBy("name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("risk") == "high").alias("exploitable"), F.count_if(F.col("risk") == "low").alias("audit_only"), F.max(S.severity_score(F.col("severity"))).alias("score")
    )


def riskiest_first(found: DataFrame, *then: str) -> DataFrame:
    """Vulnerabilities (name, severity, risk) by risk, severity and name, and by the columns ``then`` where these agree; nulls last."""
    risk = F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).when(F.col("risk") == "low", 2).otherwise(3)
    return found.orderBy(risk, S.severity_rank(F.col("severity")), *(F.asc_nulls_last(c) for c in ("name", *then)))


def vulnerable_usage(lines: DataFrame, packages: DataFrame) -> DataFrame:
    """name, imports, calls of packages (name, functions) in the lines (file, line, line_text) of code.

    Lines meet packages on the module that they import, and functions on the name before a bracket,
    by equality. A package without functions, or with ``*``, is called wherever it is imported.
    """
    text = F.col("line_text")
    module = F.coalesce(F.nullif(F.regexp_extract(text, r"""(?:\bfrom|\brequire\s*\(|\bimport\s*\()\s*['"]([^'"]+)['"]""", 1), F.lit("")), F.lit(None).cast("string"))
    root = F.when(module.startswith("@"), F.substring_index(module, "/", 2)).otherwise(F.substring_index(module, "/", 1))
    imports = lines.select("file", "line", root.alias("name")).filter("name IS NOT NULL").join(packages.select("name"), "name")
    per_import = imports.groupBy("name").agg(F.count(F.lit(1)).alias("imports"))
    called = lines.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1))).alias("function"))
    named = packages.select("name", F.explode("functions").alias("function")).filter("function <> '*'")
    per_call = called.join(named, "function").groupBy("name").agg(F.countDistinct("file", "line").alias("calls"))
    every = F.coalesce(F.size("functions") <= 0, F.lit(True)) | F.array_contains("functions", "*")
    out = packages.join(per_import, "name", "left").join(per_call, "name", "left").withColumn("imports", F.coalesce("imports", F.lit(0)))
    return out.select("name", "imports", F.when(every, F.col("imports")).otherwise(F.coalesce("calls", F.lit(0))).alias("calls"))


def actual_risk(imports: Column, calls: Column, known: Column) -> Column:
    """low where a package is not imported, or what is vulnerable in it is not called; medium where that is not known."""
    return F.when(imports == 0, "low").when(~known, "medium").when(calls > 0, "high").otherwise("low")


def effort(update: Column, breaking: Column, n_dependents: Column) -> Column:
    return F.when((update == "major") | breaking, "high").when((update == "minor") & (n_dependents > 5), "medium").otherwise("low")


def recommendation(deprecated: Column, unmaintained: Column, worst_cve: Column, update: Column, effort_: Column) -> Column:
    """struct<action, priority>; the first case that holds."""
    told = lambda a, p: F.struct(F.lit(a).alias("action"), (p if isinstance(p, Column) else F.lit(p)).alias("priority"))
    urgent = F.when(worst_cve.isin("critical", "high"), "critical").otherwise("high")
    return (
        F.when(deprecated, told("replace", "high"))
        .when(unmaintained, told("evaluate", "medium"))
        .when(worst_cve.isNotNull(), told("update", urgent))
        .when(update == "major", told("evaluate", "low"))
        .otherwise(told("update", F.when(effort_ == "high", "medium").otherwise("low")))
    )


def advisories(packages: DataFrame, known: DataFrame, usage: DataFrame) -> DataFrame:
    """Advisories that touch installed packages, with the risk that usage shows.

    ``known``: name, cve, severity, fixed_in, function. ``usage``: project, name, function (null: imported only).
    """
    hit = packages.join(known, "name").filter(F.col("fixed_in").isNull() | (S.version(F.col("version")) < S.version(F.col("fixed_in"))))
    imported = usage.select("project", "name").distinct().withColumn("_imported", F.lit(True))
    called = usage.filter("function IS NOT NULL").select("project", "name", "function").distinct().withColumn("_called", F.lit(True))
    seen = hit.join(imported, ["project", "name"], "left").join(called, ["project", "name", "function"], "left")
    risk = F.when(F.col("_called"), "high").when(F.col("_imported"), "medium").otherwise("low")
    breaking = F.when(F.col("fixed_in").isNull(), F.lit(None)).otherwise(S.version(F.col("fixed_in"))[0] > S.version(F.col("version"))[0])
    priority = F.when((risk == "high") & (F.lower("severity") == "critical"), "critical").when(risk == "high", "high").when(risk == "medium", "medium").otherwise("low")
    return seen.withColumn("risk", risk).withColumn("breaking_fix", breaking).withColumn("priority", priority).drop("_imported", "_called")


#: Licences of well-known packages, for where no file tells them; those not named here are MIT.
KNOWN_MIT = (
    "react react-dom react-is next express koa vue svelte angular lodash underscore ramda axios node-fetch got zod yup framer-motion motion tailwindcss postcss autoprefixer tailwind-merge tw-animate-css clsx classnames "
    "react-router react-router-dom resend nodemailer vite esbuild webpack rollup parcel eslint prettier biome jest vitest mocha chai commander yargs meow chalk kleur cross-env uuid nanoid cuid date-fns dayjs luxon moment "
    "mongoose pg mysql2 better-sqlite3 jsonwebtoken bcrypt bcryptjs cors helmet morgan jimp socket.io ws micromatch fs-extra debug pino winston ms"
).split()
KNOWN_OTHER = {
    "typescript": "Apache-2.0", "tslib": "0BSD", "joi": "BSD-3-Clause", "class-variance-authority": "Apache-2.0", "lucide-react": "ISC", "lucide": "ISC", "wouter": "ISC", "picocolors": "ISC", "dotenv": "BSD-2-Clause",
    "prisma": "Apache-2.0", "drizzle-orm": "Apache-2.0", "sharp": "Apache-2.0", "puppeteer": "Apache-2.0", "playwright": "Apache-2.0", "glob": "ISC", "minimatch": "ISC", "graceful-fs": "ISC", "semver": "ISC",
}


def known_licence(name: Column) -> Column:
    """The licence of a well-known package, by its name or by what follows its scope."""
    other = F.create_map(*(F.lit(x) for pair in KNOWN_OTHER.items() for x in pair))
    of = lambda n: F.coalesce(F.try_element_at(other, n), F.when(n.isin(*KNOWN_MIT), "MIT"))
    return F.coalesce(of(name), of(F.element_at(F.split(name, "/"), -1)))


def best_advisory(found: DataFrame, known: DataFrame) -> DataFrame:
    """name, cve, matched of found vulnerabilities (name, cve) with the known one (name, cve) that fits best: the same, one of its year, else the first."""
    year = lambda c: F.regexp_extract(c, r"^CVE-(\d{4})-", 1)
    # Dealt by name over as many tasks as there is input for: what both are joined and ordered by is never one task's because its files are few.
    n = tasks_for(found, known)
    met = found.select("name", "cve").repartition(n, "name").join(known.select("name", F.col("cve").alias("matched")).repartition(n, "name"), "name")
    rank = F.when(F.col("cve") == F.col("matched"), 0).when((year(F.col("cve")) != "") & (year(F.col("cve")) == year(F.col("matched"))), 1).otherwise(2)
    return met.groupBy("name", "cve").agg(F.min_by("matched", F.struct(rank.alias("r"), "matched")).alias("matched"))


def licence_chain(packages: DataFrame, *found: DataFrame) -> DataFrame:
    """The first of several licence tables (name, license) that knows a package, else what is well known, else 'unknown'; with its class and risk."""
    out, names = packages, []
    for k, table in enumerate(found):
        per = table.filter("license <> 'unknown'").groupBy("name").agg(F.min("license").alias(f"_l{k}"))
        out = out.join(per, "name", "left")
        names.append(F.col(f"_l{k}"))
    out = out.withColumn("license", F.coalesce(*names, known_licence(F.col("name")), F.lit("unknown"))).drop(*(f"_l{k}" for k in range(len(found))))
    return out.withColumn("category", S.license_class(F.col("license"))).withColumn("risk", S.license_risk(F.col("license")))


def licence_histogram(packages: DataFrame, by: str = "category") -> DataFrame:
    return packages.groupBy(by).agg(F.count(F.lit(1)).alias("packages"))


def licences_by_risk(packages: DataFrame) -> DataFrame:
    """license, risk, packages: high risks first, then medium, unknown, low."""
    per = packages.groupBy("license").agg(F.count(F.lit(1)).alias("packages")).withColumn("risk", S.license_risk(F.col("license")))
    return per.orderBy(S.license_risk_rank(F.col("risk")), F.desc("packages"), "license")


def licence_issues(packages: DataFrame) -> DataFrame:
    """name, license, severity of packages whose licence asks for something."""
    severity = F.when(F.col("category") == "restrictive", "critical").when(F.col("category") == "copyleft", "warning")
    return packages.withColumn("severity", severity).filter("severity IS NOT NULL").select("name", "license", "severity")


def breaking_changes(changelog: DataFrame, *key: str) -> DataFrame:
    """Bullets under a 'breaking' heading of changelogs (key..., line, line_text), until a heading without it."""
    state = F.when(F.lower("line_text").contains("breaking") & F.col("line_text").rlike(r"^\s*[#*]|:$"), 1).when(F.col("line_text").rlike(r"^\s*#"), 0)
    inside = F.last(state, ignorenulls=True).over(Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = changelog.withColumn("_in", inside).filter((F.col("_in") == 1) & F.col("line_text").rlike(r"^\s*[-*]\s+"))
    return rows.select(*key, "line", F.regexp_replace("line_text", r"^\s*[-*]\s+", "").alias("change"))
