"""A repository's files to its dead files, dead functions and dead exports, by the operators in turn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import entries, functions, graph
from quarry.shared import written
from quarry.sources import code, configs, parse
from quarry.sources import files as sources

#: Files whose exports tools take, not imports.
TOOLING = r"\.(stories|story|spec|test|cy)\.[mc]?[jt]sx?$|(^|/)(tests?|__tests__|__mocks__|spec|e2e|cypress|playwright)/"
#: Languages whose files see each other without an import, and what their common scope is.
_TOGETHER = ("go", "java", "kotlin")


@dataclass
class Scan:
    """Tables of one scan, all by project."""

    edges: DataFrame
    entries: DataFrame
    reached: DataFrame
    dead_files: DataFrame
    dead_functions: DataFrame
    dead_exports: DataFrame


def entry_points(files: DataFrame, *more: DataFrame) -> DataFrame:
    """project, file, reason: by convention, by manifests, by configuration, and whatever else is given."""
    by_name = files.select("project", "file", code.entry_reason(F.col("file")).alias("reason")).filter("reason IS NOT NULL")
    packages = configs.packages(files)
    home = F.when(F.col("directory") == ".", F.lit("")).otherwise(F.concat("directory", F.lit("/")))
    starts = packages.select("project", F.explode("starts").alias("path"), home.alias("home")).select("project", F.concat("home", "path").alias("entry"))
    named = configs.entries(files).select("project", F.col("path").alias("entry"))
    built = entries.workspace_exports(packages.select("project", "directory", F.explode("starts").alias("path")), files).select("project", "file")
    globbed = graph.glob_seeds(files, configs.script_globs(files)).select("project", F.col("node").alias("file"))
    found = by_name
    for reason, rows in (("manifest", entries.configured(files, starts)), ("config", entries.configured(files, named)), ("package-export", built), ("script-glob", globbed)):
        found = found.unionByName(rows.select("project", "file", F.lit(reason).alias("reason")))
    for rows in more:
        found = found.unionByName(rows.select("project", "file", "reason"))
    dead_name = F.lower("file").rlike(code.NEVER_ENTRY)
    return found.filter(~dead_name).groupBy("project", "file").agg(F.min("reason").alias("reason"))


#: Class files that an equal package does not bring in, besides ``code.NEVER_ENTRY``.
_NEVER_TOGETHER = r"(^|/)(Dead|Deprecated|Legacy|Old|Unused)[A-Z][^/]*\.(java|kt)$"


def implicit_edges(files: DataFrame) -> DataFrame:
    """Files that see each other without an import, through one hub node for each group.

    Go: those of a directory, tests too. Java and Kotlin together: those of a package, whatever their source
    roots; a file that names no package has the one of its place under a source root, or none.
    """
    folder = F.when(F.col("file").contains("/"), S.dirname(F.col("file"))).otherwise("")
    said = F.regexp_extract("content", r"(?m)^[ \t]*package[ \t]+([\w.`]+)", 1)
    placed = F.translate(F.regexp_extract("file", r"(?:^|/)src/[^/]+/(?:java|kotlin)/(.+)/[^/]+$", 1), "/", ".")
    package = F.coalesce(F.nullif(F.regexp_replace(said, "`", ""), F.lit("")), F.nullif(placed, F.lit("")))
    scope = F.when(F.col("lang") == "go", F.concat(F.lit("go:"), folder)).otherwise(F.concat(F.lit("package:"), package))
    own = files.filter(F.col("lang").isin(*_TOGETHER) & ~F.lower("file").rlike(code.NEVER_ENTRY) & ~F.col("file").rlike(_NEVER_TOGETHER))
    return graph.shared_scope_edges(own.select("project", F.col("file").alias("node"), scope.alias("scope")).filter("scope IS NOT NULL"))


def analyse(files: DataFrame, *more_entries: DataFrame) -> Scan:
    """``files``: project, file, content. The rows that files parse to are written once and read by each step."""
    files = files.withColumn("lang", sources.language(F.col("file")))
    code_files = files.filter("lang IS NOT NULL")
    rows = written(parse.parsed(code_files), "parsed")
    imports = parse.imports(rows)
    targets = written(code.resolved_imports(imports, code_files, configs.aliases(files)), "targets")
    edges = targets.select("project", F.col("file").alias("src"), F.col("target").alias("dst"), F.col("type").alias("kind"))
    points = written(entry_points(files, *more_entries), "entries")
    seeds = points.select("project", F.col("file").alias("node"))
    every = edges.select("project", "src", "dst").unionByName(implicit_edges(code_files))
    reached = written(graph.reachable(every, seeds), "reached")
    nodes = code_files.filter(F.length(F.trim("content")) > 0).select("project", F.col("file").alias("node"), F.length("content").alias("size"))
    dead_files = graph.not_reached(nodes, reached, seeds).withColumn("verdict", graph.verdict(F.col("node")))
    met = imports.join(targets.select("project", "file", "type", "module", "target"), ["project", "file", "type", "module"])
    usage = graph.export_usage(reached.unionByName(seeds.withColumn("depth", F.lit(0).cast("long"))).select("project", "node").distinct(), met)
    again = rows.filter("relation = 'reexport'").select("project", "file", F.col("source_module").alias("module"), "name").join(
        targets.filter("type = 'reexport'").select("project", "file", "module", "target"), ["project", "file", "module"]
    )
    spread = graph.propagate_usage(usage.select("project", "target", "symbol"), again.select("project", F.col("file").alias("barrel"), F.col("target").alias("source"), "name"))
    exports = parse.exports(rows).filter(F.col("source_module").isNull() & ~F.col("name").isin(*graph.FRAMEWORK_EXPORTS) & ~F.col("file").rlike(TOOLING))
    kept = points.select("project", "file").unionByName(configs.in_publishable(code_files.filter("lang = 'javascript'"), configs.packages(files)))
    partly = graph.partly_dead(exports.select("project", "file", "name", "is_default").distinct(), spread, kept)
    tokens = code_files.select("project", "file", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(functions.TOKEN), 1))).alias("token"))
    dead_exports = graph.vetoed(partly.join(reached.select("project", F.col("node").alias("file")), ["project", "file"], "left_semi"), tokens)
    live = reached.select("project", "node").unionByName(seeds).distinct()
    dead_functions = functions.dead(parse.functions(rows), code_files, live)
    return Scan(edges, points, reached, dead_files, dead_functions, dead_exports)
