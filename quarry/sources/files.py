"""Repository files as a table: discovery, exclusion, language, category, generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.shipping import ship
from quarry.sources import listing

#: Directories and names that a scan leaves out.
EXCLUDED_DIRS = (
    "node_modules bower_components jspm_packages web_modules .git dist build coverage third_party 3rdparty vendor logs log tmp temp .cache cache "
    "__pycache__ .pytest_cache .mypy_cache testdata test-data test_data fixtures fixture TestData test-cases test_cases testcases conformance "
    "test-fixture obj __snapshots__ snapshots"
).split()
EXCLUDED_NAMES = r"\.min\.(js|css)$|\.(log|pyc|pyo|sql|sqlite|sqlite3|db|mp4|mov|avi|zip|tar|gz|rar)$"
EXCLUDED_PATHS = r"(^|/)(tests?/baselines|test/cases|bin/(Debug|Release))/|(^|/)cases/.*\.ts$"
#: Extensions of each language.
LANGUAGES = {
    "javascript": ".js .mjs .cjs .jsx .ts .tsx .mts .cts .vue", "python": ".py .pyi", "go": ".go", "java": ".java", "kotlin": ".kt .kts",
    "php": ".php .phtml .php3 .php4 .php5 .phps", "ruby": ".rb .rake .gemspec .ru", "rust": ".rs", "csharp": ".cs", "dart": ".dart", "swift": ".swift",
    "scala": ".scala .sc", "elixir": ".ex .exs", "haskell": ".hs .lhs", "lua": ".lua", "cpp": ".c .h .cpp .hpp .cc .hh .cxx .hxx .c++ .h++",
    "perl": ".pl .pm .t", "r": ".r .R .Rmd", "clojure": ".clj .cljs .cljc .edn", "fsharp": ".fs .fsi .fsx", "ocaml": ".ml .mli", "julia": ".jl", "zig": ".zig",
    "nim": ".nim .nims .nimble", "erlang": ".erl .hrl", "groovy": ".groovy .gradle .gvy", "crystal": ".cr", "v": ".v .vv", "objc": ".m .mm",
    "shell": ".sh .bash .zsh .fish", "powershell": ".ps1 .psm1 .psd1", "cobol": ".cob .cbl .cpy", "fortran": ".f .f90 .f95 .f03 .f08 .for .ftn", "vbnet": ".vb",
}
#: Languages of the command-line scan, first match, and its short names for rules.
RULE_LANGUAGES = (("js", r"\.(js|mjs|cjs|jsx|vue|svelte)$"), ("ts", r"\.(ts|tsx|mts|cts)$"), ("py", r"\.pyi?$"), ("go", r"\.go$"), ("php", r"\.php$"))
#: Paths of generated files, and what generated files say in their first lines.
GENERATED_PATHS = (
    r"\.generated\.(ts|tsx|js|jsx|mjs)$", r"\.g\.(ts|js)$", r"(^|/)(generated|__generated__|codegen|__graphql__|api-client|swagger-client|mocks|obj)/", r"/(graphql|gql)\.(ts|tsx|js)$", r"\.graphql\.(ts|tsx|js)$",
    r"_pb\.(js|d\.ts)$", r"_pb2(_grpc)?\.py$", r"\.pb\.(go|cc|h)$", r"(^|/)(target/generated-(test-)?sources|build/generated(-sources)?)/", r"_\.java$", r"\.Designer\.cs$", r"\.g(\.i)?\.cs$", r"(^|/)Migrations/.*\.cs$",
    r"\.AssemblyAttributes\.cs$", r"GlobalSuppressions\.cs$", r"_gen\.go$", r"mock_.*\.go$", r"_mock\.go$", r"_string\.go$", r"\.rs\.bk$", r"(^|/)(dist|build|out|output|\.next|\.nuxt|\.output|node_modules|vendor|bazel-bin|bazel-out|bazel-testlogs)/",
)
GENERATED_HEADS = (
    r"(?im)^// Code generated .* DO NOT EDIT|^// AUTO-GENERATED|^// GENERATED CODE|^// This file was auto-?generated|^# Generated by|^# DO NOT EDIT|@generated|DO NOT EDIT THIS FILE|This file is auto-?generated|Generated from |"
    r"^/\*\s*eslint-disable\s*\*/|^// @ts-nocheck"
)
#: What the command-line scan leaves out besides; it takes third_party, archives and videos in.
CLI_EXCLUDED_DIRS = (
    "node_modules bower_components .git dist build coverage logs log tmp temp .cache cache __pycache__ .pytest_cache .mypy_cache __snapshots__ snapshots test-fixtures test_fixtures __fixtures__ fixtures fixture "
    "testdata test-data vendor __mockdata__ __mock__ __for-testing__ pkg-tests-fixtures pkg-tests-specs type-tests type-test TestData testData test-cases test_cases conformance testcases test-fixture obj"
).split()
CLI_EXCLUDED_NAMES = r"\.min\.(js|css)$|\.(log|pyc|pyo|sql|sqlite|sqlite3|db)$"
#: The bucket of each extension; those of 25 languages are the language's, .vb to .vue besides.
CATEGORIES = {
    "javascript": ".js .mjs .cjs .jsx .ts .mts .cts .tsx .vue .svelte", "python": ".py .pyi", "java": ".java", "kotlin": ".kt .kts", "csharp": ".cs", "go": ".go", "rust": ".rs", "php": ".php", "ruby": ".rb", "swift": ".swift",
    "dart": ".dart", "scala": ".scala .sc", "elixir": ".ex .exs", "haskell": ".hs .lhs", "fsharp": ".fs", "ocaml": ".ml .mli", "julia": ".jl", "zig": ".zig", "nim": ".nim", "erlang": ".erl .hrl", "crystal": ".cr", "vlang": ".v",
    "perl": ".pl .pm", "clojure": ".clj .cljs .cljc", "vbnet": ".vb", "css": ".css .scss .sass .less", "assets": ".png .jpg .jpeg .gif .svg .webp .ico .woff .woff2 .ttf .eot",
}
#: Languages that the command-line scan counts: the buckets of languages, with Kotlin taken for Java and fewer ends.
CLI_LANGUAGES = {name: ends for name, ends in CATEGORIES.items() if name not in ("kotlin", "css", "assets")} | {
    "javascript": ".js .mjs .cjs .jsx .ts .mts .cts .tsx", "python": ".py", "java": ".java .kt", "perl": ".pl .pm",
}


def excluded(path: Column, profile: str = "scan") -> Column:
    """Whether a scan leaves a file out; the ``cli`` profile is that of the command line."""
    names, patterns = (EXCLUDED_DIRS, EXCLUDED_NAMES) if profile == "scan" else (CLI_EXCLUDED_DIRS, CLI_EXCLUDED_NAMES)
    dirs = "|".join(d.replace(".", r"\.") for d in names)
    return path.rlike(rf"(^|/)({dirs})/") | path.rlike(patterns) | path.rlike(EXCLUDED_PATHS)


def _by_extension(table: dict[str, str], ext: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for name, exts in table.items() for e in exts.split() for x in (e, name))), ext)


def language(path: Column) -> Column:
    """By extension, case as it is; null where none is known."""
    known = F.create_map(*(F.lit(x) for name, exts in LANGUAGES.items() for e in exts.split() for x in (e, name)))
    return F.try_element_at(known, F.regexp_extract(S.basename(path), r"(\.[^.]+)$", 1))


def rule_language(path: Column) -> Column:
    told = F.when(path.rlike(RULE_LANGUAGES[0][1]), RULE_LANGUAGES[0][0])
    for name, pattern in RULE_LANGUAGES[1:]:
        told = told.when(path.rlike(pattern), name)
    return told.otherwise("other")


def category(path: Column) -> Column:
    """One bucket for each file: a language, css, assets or other."""
    return F.coalesce(_by_extension(CATEGORIES, S.extension(path)), F.lit("other"))


def cli_language(path: Column) -> Column:
    """The command-line scan's language of a file, which takes Kotlin for Java; other where it knows none."""
    return F.coalesce(_by_extension(CLI_LANGUAGES, S.extension(path)), F.lit("other"))


def generated(path: Column, content: Column) -> Column:
    """By its path, or by what its first 20 lines say."""
    head = F.substring_index(F.coalesce(content, F.lit("")), "\n", 20)
    return path.rlike("|".join(f"(?:{p})" for p in GENERATED_PATHS)) | head.rlike(GENERATED_HEADS)


def histogram(files: DataFrame, by: Column, size: str = "size", leave: str | None = "other") -> DataFrame:
    """lang, files, size: one row for each value of ``by``, without the one to leave out."""
    per = files.withColumn("lang", by).groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("size"))
    return per if leave is None else per.filter(F.col("lang") != leave)


def totals(files: DataFrame, by: str, names: tuple[str, ...], size: str = "size") -> DataFrame:
    """One row: files, total size, and the size of each named value of ``by``."""
    of = lambda n: F.coalesce(F.sum(F.when(F.col(by) == n, F.col(size))), F.lit(0)).alias(n)
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("total"), *map(of, names))


def dead_summary(files: DataFrame) -> DataFrame:
    """One row of files (entry, dead, size): files, entry points, dead ones, their bytes and rate, and the rest, which is reached or no code."""
    dead = F.count_if("dead")
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if("entry").alias("entry_points"), dead.alias("dead_files"), F.coalesce(F.sum(F.when(F.col("dead"), F.col("size"))), F.lit(0)).alias("dead_bytes"),
        F.coalesce(F.round(100.0 * F.try_divide(dead, F.count(F.lit(1))), 2), F.lit(0.0)).alias("dead_rate"), (F.count(F.lit(1)) - dead - F.count_if("entry")).alias("other_files"),
    )


def listed(spark: SparkSession, root: str, profile: str = "scan", content: bool = True, **options: str) -> DataFrame:
    """file, size, mtime, status, content of what a scan covers, by the data source that lists before it reads.

    Filters on ``file`` and ``size`` reach the listing. Status is ``read``, ``too large``, or why a file or directory could not be read.
    """
    ship(spark)
    spark.dataSource.register(listing.Tree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    names, pattern = (EXCLUDED_DIRS, EXCLUDED_NAMES) if profile == "scan" else (CLI_EXCLUDED_DIRS, CLI_EXCLUDED_NAMES)
    options = {"dirs": "\n".join(names), "patterns": f"{pattern}\n{EXCLUDED_PATHS}", "submodules": "true", "content": str(content).lower()} | options
    return spark.read.format("quarry_tree").options(**options).load(root)


def discover(spark: SparkSession, root: str, project: str, submodules: DataFrame | None = None, profile: str = "scan") -> DataFrame:
    """project, file, size, mtime, ext, lang, status, content of every file under ``root`` that a scan covers.

    Files too large for a cell, and what can't be read, are rows without content. Folders of stores that only
    Spark's own readers open are read by these; there excluded directories are listed too, and then dropped.
    """
    if listing.known(root):
        rows = listed(spark, root, profile)
    else:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        base = root.rstrip("/").split("://")[-1].lstrip("/")
        name = F.regexp_replace(F.col("path"), rf"^[a-z]+:/+{base.replace('.', '[.]')}/+", "")
        there = read.filter(~excluded(name, profile))
        row = lambda status, text: (name.alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(status).alias("status"), text.alias("content"))
        rows = there.filter(F.col("length") < listing.MOST_BYTES).select(*row("read", F.col("content").cast("string")))
        rows = rows.unionByName(there.filter(F.col("length") >= listing.MOST_BYTES).select(*row("too large", F.lit(None).cast("string"))))
    rows = rows.withColumns({"project": F.lit(project), "ext": S.extension(F.col("file")), "lang": language(F.col("file"))})
    rows = rows.select("project", "file", "size", "mtime", "ext", "lang", "status", "content")
    return rows if submodules is None else outside_submodules(rows, submodules)


def git_commits(spark: SparkSession, path: str, commits: int = 5000) -> DataFrame:
    """commit, author, ts, added, removed, file of a working copy's log; tasks ask git for ``commits`` each. Renamed files are there under their new path."""
    ship(spark)
    spark.dataSource.register(listing.GitLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("quarry_git_log").option("commits", str(commits)).load(path)
    return rows.withColumn("file", S.renamed_path(F.col("file")))


def outside_submodules(files: DataFrame, submodules: DataFrame) -> DataFrame:
    """Files that lie in no submodule (path)."""
    inside = files.select("file", F.explode(S.ancestors(F.col("file"))).alias("path")).join(submodules.select("path").distinct(), "path", "left_semi")
    return files.join(inside.select("file").distinct(), "file", "left_anti")


def submodule_paths(gitmodules: DataFrame) -> DataFrame:
    """path of each submodule in the lines (value) of a .gitmodules file."""
    return gitmodules.select(F.regexp_extract("value", r"^\s*path\s*=\s*(.+?)\s*$", 1).alias("path")).filter("path <> ''")


def unchanged(files: DataFrame, parsed_before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to parse again, and rows parsed before that still hold, by content hash."""
    hashed = files.withColumn("hash", F.sha2(F.col("content"), 256))
    return hashed.join(parsed_before.select("file", "hash"), ["file", "hash"], "left_anti"), parsed_before.join(hashed.select("file", "hash"), ["file", "hash"], "left_semi")


def longest_scope(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each file with the deepest scope (project, directory, ...) above it; null where none is."""
    above = files.select("project", "file", F.explode(F.concat(F.array(F.lit(".")), S.ancestors(F.col("file")))).alias("directory"))
    met = above.join(scopes.select("project", "directory").distinct(), ["project", "directory"])
    depth = F.when(F.col("directory") == ".", 0).otherwise(F.length("directory"))
    best = met.groupBy("project", "file").agg(F.max_by("directory", depth).alias("scope"))
    return files.join(best, ["project", "file"], "left")


#: Line numbers of a log that one task takes together.
LOG_BLOCK = 1 << 18


def git_log(lines: DataFrame, block: int = LOG_BLOCK) -> DataFrame:
    """file, author, ts of a ``--numstat`` log (source, n, value) with headers ``commit|author|iso time``.

    A header holds for the rows below it until the next, which is a running last value over the line
    number: within blocks of numbers, and over the blocks' own last headers where a block begins without one.
    """
    from pyspark.sql import Window

    head = F.when(F.col("value").rlike(r"^[0-9a-f]{7,40}\|"), F.col("value"))
    dealt = lines.select("source", "n", "value", F.floor(F.col("n") / block).alias("_block"), head.alias("_head"))
    ends = dealt.groupBy("source", "_block").agg(F.max_by("_head", F.when(F.col("_head").isNotNull(), F.col("n"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col("source").alias("_of"), F.col("_block").alias("_at"), before.alias("_before"))
    own = F.last("_head", ignorenulls=True).over(Window.partitionBy("source", "_block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    carried = dealt.withColumn("_head", own).join(ends, F.col("source").eqNullSafe(F.col("_of")) & F.col("_block").eqNullSafe(F.col("_at")), "left")
    carried = carried.withColumn("_head", F.coalesce("_head", "_before"))
    rows = carried.filter(F.col("value").rlike(r"^(\d+|-)\t(\d+|-)\t"))
    part = lambda k: F.split("_head", r"\|")[k]
    return rows.select(S.renamed_path(F.split("value", "\t")[2]).alias("file"), part(1).alias("author"), part(2).try_cast("timestamp").alias("ts"))
