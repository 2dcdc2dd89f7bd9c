"""What source files declare and import, by one table of patterns for all languages.

Each rule is (language, relation, type, pattern); its first group is the name. Rules run inside
Spark on whole files, and a file that a rule can't read gives no rows for it, never an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S

_ID = r"([A-Za-z_$][\w$]*)"
RULES = (
    ("javascript", "import", "esm", r"""(?m)^\s*import\s+(?:[^'"();]*?\s+from\s+)?['"]([^'"]+)['"]"""),
    ("javascript", "import", "commonjs", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""),
    ("javascript", "import", "dynamic-import", r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)"""),
    ("javascript", "import", "import-meta-glob", r"""import\.meta\.glob(?:Eager)?\(\s*['"]([^'"]+)['"]"""),
    ("javascript", "import", "reexport", r"""(?m)^\s*export\s+(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]"""),
    ("javascript", "export", "function", rf"(?m)^\s*export\s+(?:async\s+)?function\s*\*?\s*{_ID}"),
    ("javascript", "export", "class", rf"(?m)^\s*export\s+(?:abstract\s+)?class\s+{_ID}"),
    ("javascript", "export", "variable", rf"(?m)^\s*export\s+(?:const|let|var|enum|interface|type)\s+{_ID}"),
    ("javascript", "export", "default", r"(?m)^\s*export\s+(default)\b"),
    ("javascript", "function", "function", rf"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"),
    ("javascript", "function", "arrow", rf"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+{_ID}\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>"),
    ("javascript", "class", "class", rf"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}"),
    ("javascript", "function", "method", rf"(?m)^\s+(?:static\s+|async\s+|private\s+|public\s+|protected\s+)*(#?[A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::\s*[^{{]+)?\{{"),
    ("python", "import", "import", r"(?m)^\s*import\s+([\w.]+)"),
    ("python", "import", "from", r"(?m)^\s*from\s+([\w.]+)\s+import\b"),
    ("python", "function", "function", r"(?m)^\s*(?:async\s+)?def\s+(\w+)"),
    ("python", "class", "class", r"(?m)^\s*class\s+(\w+)"),
    ("go", "import", "single", r'(?m)^\s*import\s+(?:\w+\s+)?"([^"]+)"'),
    ("go", "import", "block", r'(?m)^[ \t]+(?:[\w.]+[ \t]+)?"([^"\s]+)"[ \t]*$'),
    ("go", "function", "function", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    ("go", "class", "struct", r"(?m)^type\s+(\w+)\s+struct\b"),
    ("go", "class", "interface", r"(?m)^type\s+(\w+)\s+interface\b"),
    ("java", "import", "import", r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+);"),
    ("java", "class", "class", r"(?m)^\s*(?:public\s+|abstract\s+|final\s+)*(?:class|interface|enum|record)\s+(\w+)"),
    ("java", "function", "method", r"(?m)^\s+(?:public|private|protected)\s+(?:static\s+|final\s+)*[\w<>\[\], ]+\s+(\w+)\s*\("),
    ("kotlin", "import", "import", r"(?m)^\s*import\s+([\w.*]+)"),
    ("kotlin", "function", "function", r"(?m)^\s*(?:\w+\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(\w+)"),
    ("kotlin", "class", "class", r"(?m)^\s*(?:\w+\s+)*(?:class|interface|object)\s+(\w+)"),
    ("csharp", "import", "using", r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+);"),
    ("csharp", "class", "class", r"(?m)^\s*(?:\w+\s+)*(?:class|interface|struct|enum|record)\s+(\w+)"),
    ("csharp", "function", "method", r"(?m)^[ \t]+(?:(?:public|private|protected|internal|static|async|override|virtual|sealed|abstract|partial|extern|new|unsafe)\s+)+[\w<>\[\],.?]+\s+(\w+)\s*(?:<[^>(\n]*>)?\("),
    ("rust", "import", "use", r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"),
    ("rust", "import", "mod", r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;"),
    ("rust", "function", "fn", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"),
    ("rust", "class", "struct", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"),
    ("php", "import", "use", r"(?m)^\s*use\s+(?:function\s+)?([\w\\]+)"),
    ("php", "function", "function", r"(?m)^\s*(?:\w+\s+)*function\s+(\w+)"),
    ("php", "class", "class", r"(?m)^\s*(?:abstract\s+|final\s+)*(?:class|interface|trait)\s+(\w+)"),
    ("ruby", "import", "require", r"""(?m)^\s*require(?:_relative)?\s+['"]([^'"]+)['"]"""),
    ("ruby", "function", "function", r"(?m)^\s*def\s+(?:self\.)?(\w+[?!=]?)"),
    ("ruby", "class", "class", r"(?m)^\s*(?:class|module)\s+([\w:]+)"),
    ("swift", "import", "import", r"(?m)^\s*(?:@\w+\s+)?import\s+(\w+)"),
    ("swift", "function", "function", r"(?m)^\s*(?:\w+\s+)*func\s+(\w+)"),
    ("swift", "class", "class", r"(?m)^\s*(?:\w+\s+)*(?:class|struct|enum|protocol|actor)\s+(\w+)"),
    ("dart", "import", "import", r"""(?m)^\s*import\s+['"]([^'"]+)['"]"""),
    ("dart", "class", "class", r"(?m)^\s*(?:abstract\s+)?(?:class|mixin|enum|extension)\s+(\w+)"),
    ("scala", "import", "import", r"(?m)^\s*import\s+([\w.]+)"),
    ("scala", "class", "class", r"(?m)^\s*(?:\w+\s+)*(?:class|object|trait)\s+(\w+)"),
    ("scala", "function", "def", r"(?m)^\s*(?:\w+\s+)*def\s+(\w+)"),
    ("elixir", "import", "alias", r"(?m)^\s*(?:alias|import|use|require)\s+([\w.]+)"),
    ("elixir", "function", "function", r"(?m)^\s*defp?\s+(\w+[?!]?)"),
    ("elixir", "class", "module", r"(?m)^\s*defmodule\s+([\w.]+)"),
    ("haskell", "import", "import", r"(?m)^import\s+(?:qualified\s+)?([\w.]+)"),
    ("haskell", "function", "signature", r"(?m)^([a-z]\w*'?)\s*::"),
    ("lua", "import", "require", r"""\brequire\s*\(?\s*['"]([^'"]+)['"]"""),
    ("lua", "function", "function", r"(?m)^\s*(?:local\s+)?function\s+([\w.:]+)"),
    ("cpp", "import", "include", r"""(?m)^\s*#include\s+[<"]([^>"]+)[>"]"""),
    ("cpp", "class", "class", r"(?m)^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct|enum|namespace)\s+(\w+)"),
    ("perl", "import", "use", r"(?m)^\s*(?:use|require)\s+([\w:]+)"),
    ("perl", "function", "sub", r"(?m)^\s*sub\s+(\w+)"),
    ("clojure", "import", "require", r"\[([\w.-]+)\s+:(?:as|refer)"),
    ("clojure", "function", "function", r"\(defn-?\s+([\w?!*-]+)"),
    ("fsharp", "import", "open", r"(?m)^\s*open\s+([\w.]+)"),
    ("fsharp", "function", "let", r"(?m)^\s*let\s+(?:rec\s+|inline\s+)*(\w+)"),
    ("ocaml", "import", "open", r"(?m)^\s*open\s+([\w.]+)"),
    ("ocaml", "function", "let", r"(?m)^\s*let\s+(?:rec\s+)?(\w+)"),
    ("julia", "import", "using", r"(?m)^\s*(?:using|import)\s+([\w.]+)"),
    ("julia", "function", "function", r"(?m)^\s*function\s+(\w+!?)"),
    ("zig", "import", "import", r"""@import\(\s*"([^"]+)"\s*\)"""),
    ("zig", "function", "function", r"(?m)^\s*(?:pub\s+)?fn\s+(\w+)"),
    ("nim", "import", "import", r"(?m)^\s*(?:import|include)\s+([\w/]+)"),
    ("nim", "function", "proc", r"(?m)^\s*(?:proc|func|method|template|macro)\s+(\w+)"),
    ("erlang", "import", "include", r"""(?m)^-include(?:_lib)?\("([^"]+)"\)"""),
    ("erlang", "function", "function", r"(?m)^([a-z]\w*)\([^)]*\)\s*(?:when[^-]*)?->"),
    ("crystal", "import", "require", r"""(?m)^\s*require\s+"([^"]+)\""""),
    ("crystal", "class", "class", r"(?m)^\s*(?:abstract\s+)?(?:class|module|struct|enum)\s+([\w:]+)"),
    ("crystal", "function", "def", r"(?m)^\s*(?:private\s+|protected\s+)?def\s+(?:self\.)?(\w+[?!=]?)"),
    ("v", "import", "import", r"(?m)^\s*import\s+([\w.]+)"),
    ("v", "function", "function", r"(?m)^\s*(?:pub\s+)?fn\s+(?:\([^)]*\)\s*)?(\w+)"),
    ("vbnet", "import", "Imports", r"(?mi)^\s*Imports\s+([\w.]+)"),
    ("vbnet", "class", "class", r"(?mi)^\s*(?:\w+\s+)*(?:Class|Module|Structure|Interface)\s+(\w+)"),
    ("r", "import", "library", r"""\b(?:library|require|source)\(\s*['"]?([\w./-]+)['"]?\s*\)"""),
    ("r", "function", "function", r"(?m)^\s*([\w.]+)\s*(?:<-|=)\s*function\s*\("),
    ("shell", "import", "source", r"(?m)^\s*(?:source|\.)\s+(\S+)"),
    ("shell", "function", "function", r"(?m)^\s*(?:function\s+)?(\w+)\s*\(\)\s*\{"),
    ("powershell", "function", "function", r"(?mi)^\s*function\s+([\w-]+)"),
    ("groovy", "class", "class", r"(?m)^\s*(?:\w+\s+)*(?:class|interface|trait|enum)\s+(\w+)"),
    ("objc", "import", "include", r"""(?m)^\s*#(?:import|include)\s+[<"]([^>"]+)[>"]"""),
    ("objc", "class", "interface", r"(?m)^\s*@(?:interface|implementation|protocol)\s+(\w+)"),
    ("cobol", "class", "program", r"(?mi)^\s*PROGRAM-ID\.\s+([\w-]+)"),
    ("fortran", "function", "subroutine", r"(?mi)^\s*(?:recursive\s+)?(?:subroutine|function|module|program)\s+(\w+)"),
)
_KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "constructor", "with", "do", "else", "new", "await", "typeof")


def declarations(files: DataFrame, rules=RULES) -> DataFrame:
    """project, file, lang, relation, type, name of ``files`` (project, file, lang, content)."""

    def tagged(relation: str, kind: str):
        return lambda n: F.struct(F.lit(relation).alias("relation"), F.lit(kind).alias("type"), n.alias("name"))

    def one(lang: str):
        found = [F.transform(F.regexp_extract_all("content", F.lit(pattern), 1), tagged(relation, kind)) for own, relation, kind, pattern in rules if own == lang]
        return F.when(F.col("lang") == lang, F.concat(*found))

    every = F.coalesce(*(one(lang) for lang in dict.fromkeys(r[0] for r in rules)))
    rows = files.select("project", "file", "lang", F.explode(every).alias("d")).select("project", "file", "lang", "d.*")
    return rows.filter((F.col("type") != "method") | ~F.col("name").isin(*_KEYWORDS)).distinct()


def imports(files: DataFrame) -> DataFrame:
    return declarations(files).filter("relation = 'import'").select("project", "file", "lang", "type", F.col("name").alias("module"))


#: Extensions tried for an import without one, in order, then its index file.
TRIED = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def _candidates(target, lang):
    js = F.transform(F.array(*map(F.lit, TRIED)), lambda e: F.concat(target, e))
    # An import may name the compiled file of a TypeScript source.
    js = F.concat(js, F.array(F.regexp_replace(target, r"\.jsx?$", ".ts"), F.regexp_replace(target, r"\.jsx?$", ".tsx")))
    return F.when(lang == "javascript", js).otherwise(F.array(target))


#: For each language: what separates the parts of a module's name, the ends its file may have, and
#: whether shorter names are tried when the whole names no file, because the last part may be a member.
MODULES = {
    "python": (".", (".py", "/__init__.py"), True), "java": (".", (".java", ".kt"), True), "kotlin": (".", (".kt", ".java"), True), "scala": (".", (".scala", ".sc"), True),
    "rust": ("::", (".rs", "/mod.rs"), True), "csharp": (".", (".cs",), False), "php": ("\\", (".php", ""), False), "ruby": ("/", (".rb", ""), False),
    "elixir": (".", (".ex", ".exs"), False), "haskell": (".", (".hs", ".lhs"), False), "dart": ("/", ("", ".dart"), False), "swift": ("/", (".swift",), False),
    "zig": ("/", ("", ".zig"), False), "nim": ("/", (".nim",), False), "crystal": ("/", (".cr", ""), False), "erlang": ("/", ("", ".erl", ".hrl"), False),
    "perl": ("::", (".pm", ".pl"), False), "clojure": (".", (".clj", ".cljs", ".cljc"), False), "fsharp": (".", (".fs",), False), "ocaml": (".", (".ml", ".mli"), False),
    "julia": (".", (".jl",), False), "v": (".", (".v",), False), "vbnet": (".", (".vb",), False), "lua": (".", (".lua", "/init.lua"), False), "cpp": ("/", ("",), False),
    "objc": ("/", ("",), False), "r": ("/", ("", ".R", ".r"), False), "shell": ("/", ("",), False),
}
#: Languages whose relative names hold from the importing file's directory.
_FROM_HERE = ("php", "ruby", "dart", "zig", "nim", "crystal", "cpp", "objc", "lua", "shell", "r", "erlang", "julia")


def _stem(lang: str, module):
    """The module's name as a path without its end."""
    separator, _, _ = MODULES[lang]
    name = F.regexp_replace(module, "^package:[\\w]+/", "") if lang == "dart" else F.regexp_replace(module, r"^(crate|self|super|Self)::", "") if lang == "rust" else module
    if separator == "." and lang != "python":
        name = F.regexp_replace(name, r"\.[*_]$", "")
    path = F.replace(name, F.lit(separator), F.lit("/")) if separator != "/" else name
    path = F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), "/$", "")
    if lang == "elixir":
        return F.lower(F.regexp_replace(path, "([a-z0-9])([A-Z])", "$1_$2"))
    if lang == "clojure":
        return F.replace(path, F.lit("-"), F.lit("_"))
    if lang == "ocaml":
        return F.concat(F.lower(F.substring(path, 1, 1)), F.expr("''"), F.substring(path, 2, 2147483647))
    return path


def _keys(lang: str, module, folder):
    """array<struct<how, path>>: what the module's file may be called, likeliest first.

    ``path`` is a whole path, ``end`` the end of one, ``folder`` a directory.
    """
    _, ends, shorter = MODULES[lang]
    row = lambda how, p: F.struct(F.lit(how).alias("how"), p.alias("path"))
    with_ends = lambda how, stem: [row(how, F.concat(stem, F.lit(e))) for e in ends]
    stem = _stem(lang, module)
    out = []
    if lang == "python":
        dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
        above = F.array_join(F.slice(F.split(folder, "/"), F.lit(1), F.greatest(F.size(F.split(folder, "/")) - dots + 1, F.lit(0))), "/")
        inner = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
        near = S.normalized(F.concat_ws("/", above, F.when(inner != "", inner)))
        relative = F.flatten(F.array(F.array(*with_ends("path", near)), F.array(*with_ends("path", F.regexp_replace(near, "/[^/]*$", "")))))
        stem = F.replace(module, F.lit("."), F.lit("/"))
        return F.when(dots > 0, relative).otherwise(F.concat(F.array(*with_ends("path", S.joined(folder, stem))), _shorter(stem, ends)))
    if lang in _FROM_HERE:
        out += with_ends("path", S.joined(folder, stem))
    if lang == "rust":
        # ``mod x`` is a file or directory beside this one, or below the module this file is.
        own = F.regexp_replace(F.col("file"), r"(/mod)?\.rs$", "")
        out += with_ends("path", S.joined(folder, stem)) + with_ends("path", F.concat(own, F.lit("/"), stem))
    if shorter:
        return F.concat(F.array(*out) if out else F.array().cast("array<struct<how:string,path:string>>"), _shorter(stem, ends), F.array(row("folder", stem)) if lang in ("java", "kotlin", "scala") else F.array().cast("array<struct<how:string,path:string>>"))
    out += with_ends("end", stem)
    if lang in ("php", "csharp"):
        # The first part may be a root that stands for a source directory.
        out += with_ends("end", F.regexp_replace(stem, "^[^/]+/", ""))
    return F.array(*out)


def _shorter(stem, ends):
    pieces = F.filter(F.split(stem, "/"), lambda p: p != "")
    stems = F.transform(F.sequence(F.greatest(F.size(pieces), F.lit(1)), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/"))
    each = F.flatten(F.transform(stems, lambda x: F.transform(F.array(*map(F.lit, ends)), lambda e: F.struct(F.lit("end").alias("how"), F.concat(x, e).alias("path")))))
    return F.filter(each, lambda x: F.length(x["path"]) > 0)


def _go(module):
    """The import's directory: with its leading parts dropped one by one."""
    pieces = F.split(module, "/")
    tails = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.array_join(F.slice(pieces, k + 1, F.size(pieces)), "/"))
    return F.transform(tails, lambda t: F.struct(F.lit("folder").alias("how"), t.alias("path")))


def resolved(imports_: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """project, src, dst, kind: imports that name files of the project, by the first way that finds any.

    Every import (project, file, lang, type, module, and specifiers where they are known) becomes
    ranked keys, which meet the files by equality: on the whole path, on the end of the path (a file
    is there under every end it has, so no pattern is tried), or on the directory. Relative paths and
    aliases (project, prefix, target; the longest prefix first) hold for JavaScript; the others go by
    ``MODULES``, Go by directory.
    """
    first = resolved_imports(imports_, files, aliases)
    return first.select("project", F.col("file").alias("src"), F.col("target").alias("dst"), F.col("type").alias("kind")).distinct()


def resolved_imports(imports_: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """project, file, lang, type, module, target: one row for each import and file that it names, as in ``resolved``."""
    folder = F.when(F.col("file").contains("/"), S.dirname(F.col("file"))).otherwise("")
    module = F.col("module")
    rows = imports_.withColumn("origin", module)
    if "specifiers" in imports_.columns:
        # ``from package import member``: the member may be a module of its own.
        plain = F.filter(F.transform("specifiers", lambda s: s["name"]), lambda n: n != "*")
        members = F.transform(plain, lambda n: F.when(module.rlike(r"\.$"), F.concat(module, n)).otherwise(F.concat(module, F.lit("."), n)))
        each = F.when((F.col("lang") == "python") & (F.col("type") == "from") & (F.size(plain) > 0), members).otherwise(F.array(module))
        rows = rows.withColumn("module", F.explode(each)).drop("specifiers")
    rows = rows.select("project", "file", "lang", "type", "module", "origin").distinct().withColumn("_k", F.xxhash64("project", "file", "type", "module"))
    whole = lambda paths: F.transform(paths, lambda p: F.struct(F.lit("path").alias("how"), p.alias("path")))
    relative = rows.filter(module.rlike(r"^\.{1,2}(/|$)") & (F.col("lang") == "javascript"))
    parts = [relative.select("*", F.posexplode(whole(_candidates(S.joined(S.dirname(F.col("file")), module), F.col("lang")))).alias("rank", "key"))]
    if aliases is not None:
        # An import meets its aliases on the parts before each of its slashes, and on itself.
        heads = F.array_distinct(F.concat(F.array(module), F.transform(S.ancestors(module), lambda a: F.concat(a, F.lit("/"))), S.ancestors(module)))
        own = aliases.select("project", F.col("prefix").alias("_head"), "target").distinct()
        hit = rows.filter("lang = 'javascript'").withColumn("_head", F.explode(heads)).join(own, ["project", "_head"])
        target = S.normalized(F.concat("target", F.expr("substring(module, length(_head) + 1)")))
        far = hit.select(*rows.columns, F.length("_head").alias("_length"), F.posexplode(whole(_candidates(target, F.col("lang")))).alias("_at", "key"))
        parts.append(far.select(*rows.columns, (F.col("_at") + 100 * (1000 - F.col("_length"))).alias("rank"), "key"))
    keyed = F.when(F.col("lang") == "go", _go(module))
    for lang in MODULES:
        keyed = keyed.when(F.col("lang") == lang, _keys(lang, module, folder))
    parts.append(rows.filter("lang <> 'javascript'").select("*", F.posexplode(keyed).alias("rank", "key")))
    candidates = reduce(lambda a, b: a.unionByName(b), parts).select("*", "key.how", "key.path").drop("key")
    found = candidates.join(_index(files), ["project", "how", "path"]).filter("dst <> file")
    first = found.withColumn("_first", F.min("rank").over(Window.partitionBy("project", "_k", "file"))).filter("rank = _first")
    return first.select("project", "file", "lang", "type", F.col("origin").alias("module"), F.col("dst").alias("target")).distinct()


def _index(files: DataFrame) -> DataFrame:
    """project, how, path, dst: every key that a file can be found by."""
    row = lambda how, p: F.struct(F.lit(how).alias("how"), p.alias("path"))
    pieces = F.split("file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, n, F.size(pieces)), "/"))
    folder = F.when(F.col("file").contains("/"), S.dirname(F.col("file"))).otherwise("")
    by_folder = F.col("file").rlike(r"\.(go|java|kt|scala)$") & ~F.col("file").rlike(r"_test\.go$")
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split(folder, "/"))), lambda n: F.array_join(F.slice(F.split(folder, "/"), n, F.size(F.split(folder, "/"))), "/"))
    none = F.array().cast("array<struct<how:string,path:string>>")
    keys = F.concat(
        F.array(row("path", F.col("file"))),
        F.when(F.col("file").rlike(r"\.([mc]?[jt]sx?|vue|svelte)$"), none).otherwise(F.transform(ends, lambda e: row("end", e))),
        F.when(by_folder, F.transform(F.when(F.col("file").endswith(".go"), F.array(folder)).otherwise(folders), lambda d: row("folder", d))).otherwise(none),
    )
    return files.select("project", F.col("file").alias("dst"), F.explode(keys).alias("k")).select("project", "k.how", "k.path", "dst").distinct()


_SCRIPTS = r"\.([mc]?[jt]s|[jt]sx)$"
#: Directories whose files tools and run times start from or load by their place, by reason; anywhere in a path.
ENTRY_FOLDERS = (
    ("command", "commands bin script scripts cli/commands management/commands tasks"),
    ("test", "e2e playwright __tests__ __mocks__ testing fixtures __fixtures__ __testfixtures__ test/assets tests/assets test/setup tests/setup __checks__ test-d spec specs intTest test_data test-data testdata bench benchmark benchmarks chromatic"),
    ("build", "dist build out builds esm polyfill polyfills shim shims __shims__ buildSrc cache-dir code_generators generated __generated__ @generated _generated openapi-gen"),
    ("template", "template templates starter starters example examples example-app example-apps sandbox demo demos sample samples playground playgrounds recipes tutorial"),
    ("locale", "locale locales i18n l10n lang"),
    ("data", "schema schemas migrations seed seeds db/migrate db/post_migrate database/migrations database/seeders"),
    ("plugin", "plugin plugins extension extensions addon addons integration integrations connector connectors adapter adapters provider providers nodes composable composables mixin mixins snippets registry reporters internal-plugins"),
    ("loaded", "router routers store stores worker workers experiment experiments workflows codemod codemods plop plops config configs icon icons illustration illustrations mode modes theme themes grammar grammars keymap keymaps modules public public-api containers scanner ee enterprise premium deprecated meteor server src/theme"),
    ("deploy", "netlify vercel lambda functions hack cluster staging homebrew debug tools website site/src doc docs docs_src documentation META-INF/services mocks mock grpcmocks"),
    ("rails", "app/controllers app/models app/helpers app/jobs app/mailers app/views config/initializers config/environments app/Http/Controllers app/Models app/Providers resources/views"),
    ("ember", "app/services app/serializers app/initializers app/instance-initializers app/adapters app/transforms app/routes app/components app/mixins app/modifiers app/machines app/abilities mirage/scenarios mirage/factories mirage/fixtures mirage/models mirage/serializers mirage/identity-managers"),
)
#: Files by name, by reason. First match gives the reason.
ENTRY_FILES = (
    ("test", (
        rf"\.(test|spec)(\.\w+)*{_SCRIPTS}", rf"[-_](test|spec|worker){_SCRIPTS}", rf"\.(test-d|type-tests?|typecheck|bench(mark)?|e2e(-spec)?|unit|cy|stories|lit-stories){_SCRIPTS}",
        rf"(^|/)tests?/.+{_SCRIPTS}", rf"(^|/)tests?{_SCRIPTS}", rf"test-utils{_SCRIPTS}", rf"(^|/)setup(Vitest|Jest|Tests?){_SCRIPTS}", rf"(vitest|jest)[.-](setup|config|preset|workspace)[^/]*{_SCRIPTS}",
        r"(^|/)tests?/.+\.(py|rb|go|rs|java|kt|php|nim|exs?|scala|ml)$", r"(^|/)(test_[^/]*|[^/]*_test|tests|conftest)\.py$", r"_test\.(go|dart|clj|rb|exs)$", r"(Tests?|Spec|IT|ITCase)\.(java|kt|cs|scala|fs|vb|swift|hs)$",
        r"_spec\.(rb|cr)$", r"\.t$", r"_SUITE\.erl$", r"(^|/)runtests\.jl$", r"(smoke|performance|e2e|api)-tests?(/|$)|(^|/)e2e[_-]\w+/",
    )),
    ("config", (
        r"\.(config|rc|conf)(\.\w+)*\.([mc]?[jt]s|json)$", r"(^|/)\.[\w-]*rc(\.[\w.]+)?$", r"(^|/)(plopfile|gulpfile|[Gg]runtfile|dangerfile|sidebars|gatsby-(node|config|browser|ssr)|ember-cli-build)\.\w+$",
        r"(^|/)(setup\.(py|cfg)|conf\.py|config\.py|celeryconfig\.py|build\.(rs|zig|sbt)|Cargo\.toml|mix\.exs|rebar\.config|shard\.yml|pubspec\.yaml|Project\.toml|project\.clj|deps\.edn|dune(-project)?|v\.mod|stack\.yaml|cpanfile)$",
        r"(build|settings)\.gradle(\.kts)?$", r"(^|/)(Jenkinsfile|Makefile|makefile|CMakeLists\.txt|Rakefile|Gemfile|config\.ru|artisan|composer\.json|Makefile\.PL|Build\.PL)$", r"\.(gemspec|cabal|nimble)$", r"eslint[_-]?(local[_-])?(config|rules?)",
    )),
    ("command", (r"(^|/)[\w-]*cli\.[a-z]+$", rf"(^|/)bin{_SCRIPTS}", r"(^|/)manage\.py$", r"lib/tasks/.*\.rake$", r"(^|/)post[a-z]+\.[mc]?js$", r"(^|/)bin/.*\.(dart|ml)$", r"(^|/)script/.*\.pl$")),
    ("main", (
        rf"^(src/)?(index|main|server|app|init|router){_SCRIPTS}", rf"^(apps|packages|libs)/(@?[^/]+/){{1,2}}(src/)?(index|main|server|app|init){_SCRIPTS}",
        rf"^(client|server|api|backend|functions|lambda|workers?|services|core|lib|app|web|middleware|source)/(src/)?(index|main|server|app|handler){_SCRIPTS}",
        rf"^(jobs|cron|queues|graphql|resolvers|deno|edge-functions?)/[^/]+{_SCRIPTS}", rf"^(lib|modules/[^/]+)/[^/]+{_SCRIPTS}",
        r"(^|/)(main|__main__|__init__|wsgi|asgi|app|celery)\.py$", r"(^|/)main\.(go|rs|dart|swift|kt|nim|zig|v|ml|java)$", r"(^|/)(lib|mod)\.rs$", r"(^|/)(plugin|wire|wire_gen|doc)\.go$", r"(^|/)index\.php$|(^|/)bootstrap\.php$",
        r"(Program|Startup|GlobalUsings|AssemblyInfo|Module1)\.(cs|fs|vb)$", r"Application\.(java|kt)$", r"package-info\.java$", r"(Main|Setup)\.hs$", r"(App|Main)\.(scala|swift)$", r"(^|/)Package\.swift$", r"src/root\.zig$", r"_app\.erl$",
        r"(^|/)Sources?/.*\.swift$|src/main/scala/.*\.scala$|(^|/)lib/.*\.(ex|pm)$|(^|/)src/.*\.(jl|cr|cljs?|fs)$|(^|/)src/.*\.(c|cpp|h|hpp)$",
    )),
    ("framework", (
        r"(^|/)(settings|urls|admin|models|views|serializers|signals|apps|router|routes|endpoints|deps|schemas|tasks|context_processors)\.py$", r"(^|/)(templatetags|api|routers?|services?|models?|schemas?|core|backends)/[^/]+\.py$",
        r"(Controller|Extensions?|Middleware|Module|Handler|Attribute|Hub|Filter|Converter)\.cs$", r"\.(controller|handler|store|xsd|terms|node|plugin|credentials|connector|adapter)\.([mc]?[jt]s|tsx)$", rf"\.worker{_SCRIPTS}",
        r"use\w+Store\.([mc]?[jt]s|tsx)$", r"\+(page|layout|server|error)(\.server)?\.([mc]?[jt]s|[jt]sx|svelte)$", rf"(^|/)entry\.(ssr|dev|preview|express|cloudflare|vercel|deno|bun|fastify|node){_SCRIPTS}",
        rf"(^|/)(middleware|instrumentation(-client)?){_SCRIPTS}", r"(^|/)config/(routes|application)\.rb$|(^|/)db/seeds\.rb$|(^|/)routes/(web|api)\.php$|(^|/)config/.*\.(php|exs)$",
        rf"(^|/)(background|content[_-]?script|popup|options|devtools|sidebar|panel){_SCRIPTS}", rf"jsx(-dev)?-runtime{_SCRIPTS}", r"parcel-(transformer|resolver|namer|packager|optimizer|reporter|compressor|validator)\b",
    )),
    ("pages", (r"(^|/)(pages|app|routes)/.*\.(jsx?|tsx?|vue|svelte)$",)),
    ("generated", (r"\.(pb|pb2|proto)\.(go|py|js|ts)$|_grpc_pb\.|_pb2(_grpc)?\.pyi?$|_pb\.(js|ts|d\.ts)$", rf"\.gen{_SCRIPTS}|\.min\.js$", r"(^|/)(mock_[^/]+|zz_generated[_.].*)\.go$|_generated?\.go$")),
    ("types", (r"\.d\.[mc]?ts$", r"\.pyi$", r"(^|/)(flow-typed|typeshed)/")),
    ("rust", (r"(^|/)(benches|examples|tests)/.*\.rs$", r"(^|/)(fuzz_targets|fuzz/targets|handlers|imports|syntax_helpers|completions|tracing|toolchain_info)/[^/]+\.rs$")),
)
NEVER_ENTRY = r"(^|/)(dead|deprecated|legacy|old|unused)[-_]|(^|/)dead\.[a-z]+$"


def entry_reason(path):
    """Why a file is an entry point by convention; null if it is none. Names that tell of dead code never are."""
    told = F.when(F.lower(path).rlike(NEVER_ENTRY), F.lit(None).cast("string"))
    for reason, patterns in ENTRY_FILES:
        told = told.when(path.rlike("|".join(f"(?:{p})" for p in patterns)), reason)
    for reason, words in ENTRY_FOLDERS:
        told = told.when(path.rlike(rf"(^|/)({'|'.join(w.replace('.', '[.]') for w in words.split())})/"), reason)
    return told
