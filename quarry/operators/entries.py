"""Further reasons for a file to be an entry point, and small line rules of single languages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S

#: Annotations of classes and methods that a container, a framework or a test runner starts.
STARTED = (
    "SpringBootApplication RestController Controller Configuration Component Service Repository Entity Bean Test ParameterizedTest BeforeEach AfterEach BeforeAll AfterAll Scheduled EventListener KafkaListener "
    "RabbitListener JmsListener PostConstruct PreDestroy WebServlet WebFilter WebListener Path Provider Singleton Stateless Stateful MessageDriven ApplicationScoped RequestScoped Named Aspect ControllerAdvice "
    "RestControllerAdvice Mapper Converter Plugin Extension AutoService HiltAndroidApp AndroidEntryPoint Module Mixin"
).split()
#: Decorators of classes that a container makes, and scopes in which a service is made without being asked for.
INJECTED = ("Controller", "Module", "Resolver", "Injectable", "Component", "Directive", "Pipe", "NgModule", "Service", "EntityRepository", "EventSubscriber")
PROVIDED = ("root", "any", "platform")


def glob_pattern(glob: str) -> str:
    """A pattern that matches whole paths: ``**`` crosses directories, ``*`` and ``?`` do not, braces are choices."""
    out, depth, k = "", 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if glob.startswith("**", k):
            out, k = out + ".*", k + 2
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        k += 1
    return f"^{out}$"


def re_match(glob: str, path: str) -> bool:
    return re.match(glob_pattern(glob), path) is not None


def glob_column(glob: Column) -> Column:
    """``glob_pattern`` of a column, without braces and question marks."""
    quoted = F.regexp_replace(glob, r"([.+()\[\]^$|{}\\])", r"\\$1")
    crossing = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0002"))
    inner = F.replace(crossing, F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(F.replace(inner, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*")), F.lit("$"))


def by_globs(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


def injected(decorators: Column, provided_in: Column, names: tuple[str, ...] = INJECTED) -> Column:
    """Made by a container: by a decorator that says so, or a service provided to everything."""
    known = F.arrays_overlap(decorators, F.array(*(F.lit(n) for n in names if n != "Injectable")))
    everywhere = F.array_contains(decorators, "Injectable") & F.arrays_overlap(provided_in, F.array(*map(F.lit, PROVIDED)))
    return F.coalesce(known | everywhere, F.lit(False))


def by_framework(files: DataFrame, detected: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (project, file) that a framework's convention (framework, pattern) names, where the project has it (project, framework)."""
    own = detected.join(rules, "framework")
    return files.join(own, "project").filter(F.expr("file RLIKE pattern")).select("project", "file", F.concat(F.lit("framework:"), F.col("framework")).alias("reason")).distinct()


def configured(files: DataFrame, named: DataFrame) -> DataFrame:
    """Files that an entry (project, entry) names whole, without extension, or by the end of the path; they meet on the base name."""
    stem = lambda p: S.strip_extension(S.basename(p))
    left = files.select("project", "file", stem(F.col("file")).alias("_stem"))
    right = named.select("project", F.regexp_replace("entry", r"^\./", "").alias("entry"), stem(F.col("entry")).alias("_stem"))
    plain = S.strip_extension(F.col("file"))
    end = lambda p: (p == F.col("entry")) | F.endswith(p, F.concat(F.lit("/"), F.col("entry")))
    return left.join(right, ["project", "_stem"]).filter(end(F.col("file")) | end(plain)).select("project", "file").distinct()


def autoloaded(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Files below a directory (project, directory) whose content is loaded by its place."""
    above = files.select("project", "file", F.explode(S.ancestors(F.col("file"))).alias("directory"))
    return above.join(directories.select("project", "directory").distinct(), ["project", "directory"], "left_semi").select("project", "file").distinct()


def built_to_source(path: Column) -> Column:
    """Places in the sources that a path in a build directory may come from, likeliest first."""
    bare = S.strip_extension(F.regexp_replace(path, r"^\./", ""))
    moved = F.array(F.regexp_replace(bare, r"^(dist[^/]*|lib|build|out|es|esm|cjs)/", "src/"), F.regexp_replace(bare, r"^(dist[^/]*|lib|build|out|es|esm|cjs)/", ""), bare, F.lit("src/index"))
    ends = F.array(*map(F.lit, (".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.js")))
    return F.array_distinct(F.flatten(F.transform(moved, lambda m: F.transform(ends, lambda e: F.concat(m, e)))))


def workspace_exports(packages: DataFrame, files: DataFrame) -> DataFrame:
    """The first source file that exists for each exported path (project, directory, path) of workspace packages."""
    each = packages.select("project", "directory", "path", F.posexplode(built_to_source(F.col("path"))).alias("rank", "_tail"))
    each = each.withColumn("file", F.when(F.col("directory") == ".", F.col("_tail")).otherwise(F.concat_ws("/", "directory", "_tail")))
    return each.join(files.select("project", "file"), ["project", "file"]).groupBy("project", "directory", "path").agg(F.min_by("file", "rank").alias("file"))


def by_metadata(parsed: DataFrame) -> DataFrame:
    """Files (project, file, lang, metadata map, annotations) whose content makes them a start: a main block, task, test or container class."""
    yes = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)) == "true", F.lit(False))
    started = F.arrays_overlap("annotations", F.array(*map(F.lit, STARTED)))
    go, rust = F.col("lang") == "go", F.col("lang") == "rust"
    reason = (
        F.when(yes("has_main_block"), "main-block").when(yes("has_main"), "main").when(yes("is_celery"), "task").when(started, "annotation")
        .when(go & (yes("has_init") | yes("is_test")), "init").when(rust & (yes("is_bin") | yes("is_lib")), "crate").when(yes("is_test"), "test")
    )
    return parsed.withColumn("reason", reason).filter("reason IS NOT NULL").select("project", "file", "reason")


def metadata(files: DataFrame, rows: DataFrame) -> DataFrame:
    """What ``by_metadata`` reads: project, file, lang, metadata, annotations, from files (with content) and what they parse to."""
    per = rows.filter("relation IN ('function', 'class')").groupBy("project", "file").agg(
        F.array_distinct(F.flatten(F.collect_list("annotations"))).alias("annotations"), F.bool_or((F.col("name") == "main") & (F.col("relation") == "function")).alias("_main"),
        F.bool_or((F.col("name") == "init") & (F.col("relation") == "function")).alias("_init"), F.bool_or(F.col("name").rlike("^(Test|Benchmark|Example)[A-Z_]")).alias("_test"),
    )
    c, f = F.col("content"), F.col("file")
    lang = F.col("lang")
    told = {
        "has_main_block": (lang == "python") & c.rlike(r"""(?m)^if\s+__name__\s*==\s*['"]__main__['"]"""),
        "has_main": F.coalesce(F.col("_main"), F.lit(False)) & ((lang != "go") | c.rlike(r"(?m)^package\s+main\b")) & ~lang.isin("javascript", "python"),
        "is_celery": (lang == "python") & c.rlike(r"(?m)^\s*@(?:\w+\.)?(?:shared_task|task|app\.task|celery\.task)\b"),
        "has_init": F.coalesce(F.col("_init"), F.lit(False)),
        "is_bin": (lang == "rust") & F.coalesce(F.col("_main"), F.lit(False)),
        "is_lib": f.rlike(r"(^|/)src/lib\.rs$"),
        "is_test": ((lang == "go") & F.coalesce(F.col("_test"), F.lit(False)) & f.rlike(r"_test\.go$")) | (lang.isin("ruby", "php") & c.rlike(r"(?m)<\s*(?:\w+::)*\w*Test(?:Case)?\b|\bRSpec\.describe\b|extends\s+\w*TestCase\b")),
    }
    made = F.create_map(*(x for k, v in told.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)).cast("string"))))
    return files.join(per, ["project", "file"], "left").select("project", "file", "lang", made.alias("metadata"), F.coalesce("annotations", F.array().cast("array<string>")).alias("annotations"))


def best(found: DataFrame) -> DataFrame:
    """One reason for each file of all detectors' (project, file, reason, confidence): the surest, then by name."""
    return found.groupBy("project", "file").agg(F.max_by(F.struct("reason", "confidence"), F.struct("confidence", "reason")).alias("b")).select("project", "file", "b.*")


def ruby_private(lines: DataFrame) -> DataFrame:
    """Methods below a bare ``private`` until another section or class: the section is carried down the lines."""
    section = F.when(F.col("line_text").rlike(r"^\s*(private|protected)\s*$"), "private").when(F.col("line_text").rlike(r"^\s*(public\s*$|class\s|module\s)"), "public")
    carried = F.last(section, ignorenulls=True).over(Window.partitionBy("project", "file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    name = F.regexp_extract("line_text", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)", 1)
    return lines.withColumn("_section", carried).filter((F.col("_section") == "private") & (name != "")).select("project", "file", "line", name.alias("name"))


#: Where console output is looked for, and where never.
CONSOLE_IN = r"(?i)/(components|pages|views|features|app|widgets|containers|layouts|screens|frontend|client|admin|dashboard)/|/public/.*\.(js|mjs)$|\.(component|page)\.(js|ts|jsx|tsx)$"
CONSOLE_NOT = r"\.(test|spec|stories|mock)\.(js|ts|jsx|tsx)$|__tests__|node_modules|\.min\.js$"
_CONSOLE = r"^\s*console\.(log|warn|info|debug|trace)\s*\("


def console_target(path: Column) -> Column:
    return ~path.rlike(CONSOLE_NOT) & path.rlike(CONSOLE_IN)


def _logs_only(line: Column) -> Column:
    return line.rlike(_CONSOLE) & line.rlike(r"(\);?|,)\s*$")


def console_logs(files: DataFrame) -> DataFrame:
    """project, file, n: lines that only log to the console."""
    own = F.filter(F.split("content", "\n", -1), _logs_only)
    return files.select("project", "file", F.size(own).alias("n")).filter("n > 0")


def without_console_logs(content: Column) -> Column:
    """The text as it would be without those lines."""
    return F.array_join(F.filter(F.split(content, "\n", -1), lambda x: ~_logs_only(x)), "\n")


def type_references(files: DataFrame, types: DataFrame) -> DataFrame:
    """Edges from files to those that declare a type (project, file, name) they name: tokens meet declarations by equality."""
    from quarry.operators import names

    tokens = names.index(files).select("project", F.col("file").alias("src"), F.col("token").alias("name"))
    declared = types.select("project", "name", F.col("file").alias("dst"))
    return tokens.join(declared, ["project", "name"]).filter("src <> dst").select("project", "src", "dst", F.lit("type").alias("kind")).distinct()


def by_repository(files: DataFrame) -> DataFrame:
    """Files, dead files and the dead rate of each repository and of all together."""
    per = files.rollup("project").agg(F.count(F.lit(1)).alias("files"), F.count_if("dead").alias("dead"))
    return per.withColumn("dead_rate", F.round(100.0 * F.col("dead") / F.col("files"), 2))
