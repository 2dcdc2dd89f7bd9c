"""Functions that nothing calls: who is eligible in each language, and where a name must not occur.

A name occurs in a file, a directory or a project if its token does, so occurrences are counted once
for the candidates' names and meet them by equality; no pattern is tried for each name and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.shared import written

#: Words of code, with the signs that names may begin with.
TOKEN = r"(#?[A-Za-z0-9_$]+[?!]?)"
#: Annotations and decorators that do not hand a function to a framework.
JAVA_PLAIN = (
    "Override SuppressWarnings Deprecated SafeVarargs FunctionalInterface Nullable NonNull NotNull Nonnull CheckForNull CheckReturnValue CanIgnoreReturnValue Immutable "
    "ThreadSafe GuardedBy VisibleForTesting Internal Experimental Beta ApiStatus Generated Getter Setter Builder Data Value ToString EqualsAndHashCode NoArgsConstructor "
    "AllArgsConstructor RequiredArgsConstructor Slf4j Log SneakyThrows Synchronized Cleanup"
).split()
PYTHON_PLAIN = (
    "staticmethod classmethod property cached_property abstractmethod overload override final deprecated no_type_check dataclass_transform contextmanager "
    "asynccontextmanager wraps lru_cache cache setter deleter"
).split()
#: Methods that run times call by name.
JAVA_CALLED = "readObject writeObject readResolve writeReplace readObjectNoData".split()
PYTHON_CALLED = "_ _generate_next_value_ _missing_ _ignore_".split()
CSHARP_CALLED = "Dispose Finalize".split()
#: Files whose functions are not judged.
NOT_JUDGED = {
    "go": r"_test\.go$|\.pb\.go$|\.pb\.gw\.go$|/zz_generated[^/]*\.go$|_generated\.go$|\.gen\.go$|\.generated\.go$|/mock_[^/]*\.go$|_mock\.go$|/fake_[^/]*\.go$",
    "java": r"/src/(test|it)/(java|kotlin|scala|groovy)/|/(test|it)/.*resources[^/]*/|/xdocs|/testdata/|/test-data/|/fixtures/|(^|/)samples/|/examples/|[Tt]est[Cc]ases?/|/generated/|/gen/|Generated",
    "python": r"(^|/)(tests?|testing)/|(^|/)test_[^/]*\.py$|_test\.py$|(^|/)conftest\.py$",
    "csharp": r"(?i)(^|/)[^/]*tests?/|\.g\.cs$|\.generated\.cs$|\.designer\.cs$|/obj/",
    "php": r"(?i)(^|/)tests?/|Test\.php$|_test\.php$|/fixtures?/|/migrations?/|/seeds?/|/seeders?/|/factories/|/stubs/|/views/|/resources/",
    "ruby": r"(^|/)(spec|test)s?/|_spec\.rb$|_test\.rb$|/migrations?/|/db/(seeds|schema)|/views/|/config/|/fixtures?/",
    "javascript": r"\.(test|spec|e2e|cy|stories|story)\.[mc]?[jt]sx?$|(^|/)(tests?|__tests__|__mocks__|spec|e2e|cypress|playwright)/|(^|/)(test|spec)\.[mc]?[jt]sx?$|\.d\.ts$|\.(vue|svelte)$",
}
GENERATED = r"(?im)^//\s*Code generated .* DO NOT EDIT|^//go:build\s+ignore\b|^//\s*\+build\s+ignore\b|@generated|auto-?generated|do not (edit|modify)"
#: What makes the names in a script unsafe to judge.
ESCAPES = r"\beval\s*\(|\bnew\s+Function\s*\(|\bwith\s*\("
MODULE = r"(?m)^\s*(import|export)\b|\brequire\s*\(|module\.exports|exports\.[\w$]+\s*="
TEMPLATES = r"(?i)\.(erb|haml|slim|tt|razor|cshtml|xaml|blade\.php|twig)$"


def _only(annotations: Column, plain: list[str]) -> Column:
    """None but annotations that leave a function to be called by name."""
    last = lambda a: F.element_at(F.split(a, r"\."), -1)
    return F.forall(F.coalesce(annotations, F.array().cast("array<string>")), lambda a: last(a).isin(*plain))


def dispatch_prefixes(files: DataFrame) -> DataFrame:
    """project, prefix: beginnings that code puts before a name it makes at run time, as in ``self["on_" + x]``."""
    made = r"""[\[(,]\s*f?['"`]([\w$]{2,})(?:['"]\s*\+|\$\{|#\{|\{|%s['"]\s*%)"""
    return files.select("project", F.explode(F.regexp_extract_all("content", F.lit(made), 1)).alias("prefix")).distinct()


def _text_flags(files: DataFrame) -> DataFrame:
    """What of a file's text decides over its functions, worked out once in the file's own row: texts go no further."""
    text = F.col("content")
    script = ~text.rlike(ESCAPES) & text.rlike(MODULE) & (F.length(text) <= 300 * F.size(F.split(text, "\n")))
    flags = {
        "_script": script, "_dynamic": text.rlike(r"this\s*\[\s*[^'\"`\]]|this\s*\[\s*`[^`]*\$\{"), "_injected": text.rlike(r"@(Component|Directive|Injectable|Pipe)\s*\("),
        "_generated": F.substring(text, 1, 1500).rlike(GENERATED),
    }
    return files.select("project", "file", *(flag.alias(name) for name, flag in flags.items())).filter(F.col("_generated").isNotNull())


def eligible(functions: DataFrame, files: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """The functions that may be judged by who names them, with ``scope``: where a use would have to be.

    ``functions``: as ``parse.functions`` gives them. Go: unexported plain functions, by directory.
    Java, Kotlin: private methods, by file. Python: underscore methods of classes, by directory. C#,
    PHP, Ruby: private methods, by project. JavaScript: module-local functions and ``#private``
    methods, by file; methods that TypeScript calls private, by project.
    """
    c = F.col
    f = functions.join(_text_flags(files), ["project", "file"])
    name, lang = c("name"), c("lang")
    private = c("visibility") == "private"
    script = c("_script")
    hidden = (c("type") == "method") & private & F.coalesce(c("kind") == "method", F.lit(True)) & ~c("_dynamic")
    hidden = hidden & (name.startswith("#") | ~c("_injected"))
    local = c("class_name").isNull() & c("type").isin("function", "arrow", "expression") & ~c("exported")
    rules = {
        "go": ~c("exported") & (c("type") != "method") & ~name.isin("init", "main", "_") & (c("line_count") > 1) & ~name.startswith("swagger"),
        "java": private & (c("line_count") > 1) & ~name.isin("<init>", *JAVA_CALLED) & F.coalesce(name != c("class_name"), F.lit(True)) & _only(c("annotations"), JAVA_PLAIN),
        "python": c("class_name").isNotNull() & name.startswith("_") & ~name.rlike("^__.*__$") & ~name.isin(*PYTHON_CALLED) & ~F.array_contains("annotations", "property") & _only(c("annotations"), PYTHON_PLAIN),
        "csharp": private & ~name.rlike("^[a-z]") & ~name.isin(*CSHARP_CALLED) & ~name.rlike(r"_[A-Z]\w+$") & _only(c("annotations"), ["Obsolete", "MethodImpl", "Conditional", "DebuggerStepThrough"]),
        "php": private & ~name.startswith("__"),
        "ruby": private & ~name.isin("initialize"),
        "javascript": script & (F.size(F.coalesce("annotations", F.array())) == 0) & (hidden | local),
    }
    rules["kotlin"] = rules["java"]
    scope = (
        F.when(lang.isin("go", "python"), "directory").when(lang.isin("java", "kotlin"), "file").when(lang.isin("csharp", "php", "ruby"), "project")
        .when((c("type") == "method") & ~name.startswith("#"), "project").otherwise("file")
    )
    may = F.lit(False)
    for k, rule in rules.items():
        may = may | ((lang == k) & rule & ~c("file").rlike(NOT_JUDGED["java" if k == "kotlin" else k]))
    bare = F.regexp_replace("name", "^#", "")
    out = f.filter(F.coalesce(may, F.lit(False)) & (F.length(bare) > 1) & ~c("_generated")).withColumn("scope", scope).drop("_script", "_dynamic", "_injected", "_generated")
    if prefixes is None:
        prefixes = dispatch_prefixes(files)
    # A name meets a prefix by equality: it is there with each of its beginnings.
    begun = out.select("project", "file", "name", "line", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.length(bare), F.lit(2))), lambda n: F.substring(bare, F.lit(1), n))).alias("prefix"))
    called = begun.join(prefixes, ["project", "prefix"], "left_semi").select("project", "file", "name", "line").distinct()
    return out.join(called, ["project", "file", "name", "line"], "left_anti")


def with_code(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Functions with their own lines as ``code``, and its length as ``size``."""
    lines = F.split("content", "\n", -1)
    own = F.array_join(F.slice(lines, F.col("line"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1))), "\n")
    return functions.join(files.select("project", "file", "content"), ["project", "file"]).withColumn("code", own).withColumn("size", F.length("code")).drop("content")


def occurrences(files: DataFrame, names: DataFrame) -> DataFrame:
    """project, file, line, token: where any of ``names`` (project, name) occurs."""
    lines = files.select("project", "file", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    tokens = lines.select("project", "file", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(TOKEN), 1)).alias("token"))
    wanted = names.select("project", F.col("name").alias("token")).distinct()
    # A word before a question or exclamation mark is also that word alone.
    both = tokens.withColumn("token", F.explode(F.array_distinct(F.array("token", F.regexp_replace("token", "[?!]$", "")))))
    return both.join(wanted, ["project", "token"], "left_semi")


def dead(functions: DataFrame, files: DataFrame, reached: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """Eligible functions of reached files that nothing else in their scope names, with the reason.

    Scripts and Go: a use outside the function's own lines counts. The others: any second occurrence
    in the file does, so that a wrong end of a block cannot make a function dead.
    """
    rows = eligible(functions, files, prefixes)
    if reached is not None:
        rows = rows.join(reached.select("project", F.col("node").alias("file")), ["project", "file"], "left_semi")
    # Read by each of the steps below, and made once.
    rows = written(rows, "eligible", once=True)
    kinds = files.select("project", "file", F.when(F.col("file").rlike(TEMPLATES), "any").otherwise(F.col("lang")).alias("_lang"))
    found = occurrences(files, rows).join(kinds, ["project", "file"])
    folder = S.dirname(F.col("file"))
    per_file = found.groupBy("project", "file", "token", F.col("_lang"), folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    key = ["project", "file", "name", "line"]
    own = rows.join(found.select("project", "file", F.col("token").alias("name"), F.col("line").alias("_at")), ["project", "file", "name"])
    own = own.groupBy(*key).agg(F.count(F.lit(1)).alias("own_all"), F.count_if((F.col("_at") < F.col("line")) | (F.col("_at") > F.col("end_line"))).alias("own_outside"))
    in_file = per_file.select("project", "file", F.col("token").alias("name"), F.col("n").alias("n_file"))
    in_folder = per_file.groupBy("project", "folder", F.col("token").alias("name")).agg(F.sum("n").alias("n_folder"))
    in_project = per_file.groupBy("project", F.col("token").alias("name")).agg(F.sum("n").alias("n_project"))
    judged = rows.withColumn("folder", folder).join(own, key, "left").join(in_file, ["project", "file", "name"], "left")
    judged = judged.join(in_folder, ["project", "folder", "name"], "left").join(in_project, ["project", "name"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    elsewhere = F.when(F.col("scope") == "directory", n("n_folder") - n("n_file")).when(F.col("scope") == "project", n("n_project") - n("n_file")).otherwise(0)
    here = F.when(F.col("lang").isin("javascript", "go"), n("own_outside")).otherwise(n("own_all") - 1)
    reason = F.when(F.col("lang") == "go", "unexported-never-called").when((F.col("lang") == "javascript") & F.col("class_name").isNull(), "module-local-never-called").otherwise("private-never-called")
    out = judged.filter((here <= 0) & (elsewhere <= 0))
    return out.select("project", "file", "lang", "name", "line", "end_line", "line_count", "class_name", "scope", reason.alias("reason"))
