"""Facts in configuration files: entry points, scripts, packages and build systems, by one table of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S

_SCRIPT = r"[\w@./-]+\.(?:m?[jt]sx?|cjs|py|sh)"
#: name, file pattern, content pattern whose first group is a path or name.
READERS = (
    ("webpack", r"(^|/)webpack\.[\w.]*config[\w.]*\.[cm]?[jt]s$", r"""(?:entry\s*:\s*|:\s*|\[\s*|,\s*)['"](\.{1,2}/[^'"]+)['"]"""),
    ("vite", r"(^|/)vite\.config\.[cm]?[jt]s$", r"""(?:entry|input|main)\s*:\s*(?:resolve\([^'"]*)?['"]([^'"]+)['"]"""),
    ("rollup", r"(^|/)rollup\.config\.[cm]?[jt]s$", r"""input\s*:\s*\[?\s*['"]([^'"]+)['"]"""),
    ("esbuild", r"(^|/)(esbuild|build)[\w.]*\.[cm]?[jt]s$", r"""entryPoints\s*:\s*\[\s*['"]([^'"]+)['"]"""),
    ("parcel", r"(^|/)package\.json$", r'"source"\s*:\s*"([^"]+)"'),
    ("actions", r"(^|/)\.github/workflows/[^/]+\.ya?ml$", rf"\b(?:node|npx|ts-node|tsx|python3?|bash|sh)\s+({_SCRIPT})"),
    ("gitlab", r"(^|/)\.gitlab-ci\.ya?ml$", rf"\b(?:node|npx|ts-node|tsx|python3?|bash|sh)\s+({_SCRIPT})"),
    ("jenkins", r"(^|/)Jenkinsfile$", rf"\b(?:node|npx|ts-node|tsx|python3?|bash|sh)\s+({_SCRIPT})"),
    ("docker", r"(^|/)Dockerfile[\w.]*$", rf"""(?:ENTRYPOINT|CMD)[^\n]*?["\s]({_SCRIPT})"""),
    ("federation", r"(^|/)(webpack|rspack|module-federation)[\w.]*\.[cm]?[jt]s$", r"""['"]\./[\w-]+['"]\s*:\s*['"]([^'"]+)['"]"""),
    ("serverless", r"(^|/)serverless\.ya?ml$", r"(?m)^\s*handler\s*:\s*([\w./-]+)\.\w+\s*$"),
    ("next", r"(^|/)next\.config\.[cm]?[jt]s$", r"""pageExtensions\s*:\s*\[\s*['"]([^'"]+)['"]"""),
    ("cypress", r"(^|/)cypress\.(config\.[cm]?[jt]s|json)$", r"""(?:specPattern|supportFile)["']?\s*:\s*['"]([^'"]+)['"]"""),
    ("jest", r"(^|/)(jest\.config\.[cm]?[jt]s|package\.json)$", r"""(?:setupFiles(?:AfterEnv)?|globalSetup|globalTeardown)["']?\s*:\s*\[?\s*['"](?:<rootDir>/)?([^'"]+)['"]"""),
    ("nx", r"(^|/)project\.json$", r'"(?:main|entryFile|index|tsConfig)"\s*:\s*"([^"]+)"'),
    ("angular", r"(^|/)angular\.json$", r'"(?:main|browser|polyfills|styles)"\s*:\s*"([^"]+)"'),
    ("scripts", r"(^|/)package\.json$", rf'"[\w:-]+"\s*:\s*"[^"]*?\b({_SCRIPT})'),
    ("html", r"\.html?$", r"""<script[^>]+src=["']([^"']+)["']"""),
    ("tsconfig", r"(^|/)tsconfig[\w.]*\.json$", r'"files"\s*:\s*\[\s*"([^"]+)"'),
    ("grunt", r"(^|/)[Gg]runtfile\.[cm]?[jt]s$", r"""src\s*:\s*\[?\s*['"]([^'"*]+)['"]"""),
    ("csproj", r"\.(csproj|fsproj|vbproj)$", r'<ProjectReference\s+Include="([^"]+)"'),
)
BUILD_SYSTEMS = (
    ("turborepo", r"(^|/)turbo\.json$"), ("gradle", r"(^|/)(settings|build)\.gradle(\.kts)?$"), ("maven", r"(^|/)pom\.xml$"), ("bazel", r"(^|/)(WORKSPACE|MODULE)(\.bazel)?$"),
    ("buck", r"(^|/)\.buckconfig$"), ("pants", r"(^|/)pants\.toml$"), ("go-workspace", r"(^|/)go\.work$"), ("dotnet", r"\.sln$"), ("cargo", r"(^|/)Cargo\.toml$"),
    ("python", r"(^|/)(pyproject\.toml|setup\.(py|cfg))$"),
)


def entries(files: DataFrame, readers=READERS) -> DataFrame:
    """project, reader, config, path: what configuration files (project, file, content) name, without a leading ``./``."""
    def tagged(name: str):
        return lambda p: F.struct(F.lit(name).alias("reader"), F.regexp_replace(p, r"^\./", "").alias("path"))

    none = F.array().cast("array<struct<reader:string,path:string>>")
    each = lambda name, pattern: F.transform(F.regexp_extract_all("content", F.lit(pattern), 1), tagged(name))
    found = F.concat(*(F.when(F.col("file").rlike(where), each(name, pattern)).otherwise(none) for name, where, pattern in readers))
    return files.select("project", F.col("file").alias("config"), F.explode(found).alias("e")).select("project", "e.reader", "config", "e.path").distinct()


def links(pages: DataFrame) -> DataFrame:
    """file, href of every link in pages (file, content)."""
    return pages.select("file", F.explode(F.regexp_extract_all("content", F.lit('href="([^"]+)"'), 1)).alias("href"))


def scripts(pages: DataFrame) -> DataFrame:
    """file, scripts: how many script elements each page has."""
    return pages.select("file", F.regexp_count("content", F.lit("<script")).cast("long").alias("scripts"))


def build_systems(files: DataFrame) -> DataFrame:
    """project, system, config, directory."""
    found = F.filter(F.array(*(F.when(F.col("file").rlike(p), F.lit(n)) for n, p in BUILD_SYSTEMS)), lambda x: x.isNotNull())
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    return files.select("project", F.explode(found).alias("system"), F.col("file").alias("config"), folder.alias("directory")).distinct()


def manifests(files: DataFrame) -> DataFrame:
    """project, directory, name, version, declared_in of every dependency in package.json files."""
    group = "map<string,string>"
    schema = f"dependencies {group}, devDependencies {group}, peerDependencies {group}, optionalDependencies {group}"
    read = files.filter(F.col("file").rlike(r"(^|/)package\.json$")).withColumn("j", F.from_json("content", schema))
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    def declared(k: str):
        return lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(k).alias("declared_in"))

    kinds = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    each = [F.transform(F.map_entries(F.coalesce(F.col(f"j.{k}"), F.create_map().cast(group))), declared(k)) for k in kinds]
    return read.select("project", folder.alias("directory"), F.explode(F.concat(*each)).alias("d")).select("project", "directory", "d.*")


_PACKAGE = "name string, version string, private boolean, main string, module string, source string, types string, typings string, bin string, exports string, files string, publishConfig string, workspaces string, scripts map<string,string>"
_PATHS = r'"(\.{0,2}/?[\w@./*-]+\.[\w]+)"'


def packages(files: DataFrame) -> DataFrame:
    """project, directory, name, private, publishable, starts (paths it names as its start), workspaces (globs) of package.json files."""
    read = files.filter(F.col("file").rlike(r"(^|/)package\.json$")).withColumn("j", F.from_json("content", _PACKAGE))
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise(".")
    given = F.array(*(F.col(f"j.{k}") for k in ("main", "module", "source", "types", "typings")))
    listed = F.concat(*(F.regexp_extract_all(F.concat(F.lit('"'), F.coalesce(f"j.{k}", F.lit("")), F.lit('"')), F.lit(_PATHS), 1) for k in ("bin", "exports")))
    starts = F.transform(F.filter(F.concat(given, listed), lambda p: p.isNotNull()), lambda p: F.regexp_replace(p, r"^\./", ""))
    surface = F.exists(F.array(*(F.col(f"j.{k}").isNotNull() for k in ("main", "module", "exports", "types", "typings", "bin", "files", "publishConfig"))), lambda x: x)
    globs = F.regexp_extract_all(F.coalesce("j.workspaces", F.lit("")), F.lit('"([^"]+)"'), 1)
    private = F.coalesce("j.private", F.lit(False))
    return read.select("project", folder.alias("directory"), "j.name", private.alias("private"), (~private & surface).alias("publishable"), F.array_distinct(starts).alias("starts"), globs.alias("workspaces"))


def abandoned(files: DataFrame) -> DataFrame:
    """project, directory, name of packages that nothing holds on to: named, no surface, no script that starts it, no package of the project that needs it, and none that it needs."""
    every = packages(files).filter("name IS NOT NULL AND directory <> '.'")
    needs = manifests(files).select("project", F.col("directory").alias("_by"), "name").distinct()
    own = every.select("project", "name").distinct()
    inner = needs.join(own, ["project", "name"], "left_semi")
    started = files.filter(F.col("file").rlike(r"(^|/)package\.json$")).select("project", F.regexp_replace("file", "/?[^/]*$", "").alias("directory"), F.map_keys(F.coalesce(F.from_json("content", _PACKAGE)["scripts"], F.create_map().cast("map<string,string>"))).alias("s"))
    started = started.filter(F.arrays_overlap("s", F.array(*map(F.lit, ("start", "dev", "serve", "develop", "preview"))))).select("project", "directory")
    surface = files.filter(F.col("file").rlike(r"(^|/)package\.json$")).withColumn("j", F.from_json("content", _PACKAGE))
    surface = surface.filter(F.exists(F.array(*(F.col(f"j.{k}").isNotNull() for k in ("main", "module", "exports", "types", "typings", "bin", "files", "publishConfig"))), lambda x: x))
    surface = surface.select("project", F.regexp_replace("file", "/?[^/]*$", "").alias("directory"))
    left = every.join(inner, ["project", "name"], "left_anti").join(inner.select("project", F.col("_by").alias("directory")).distinct(), ["project", "directory"], "left_anti")
    return left.join(started, ["project", "directory"], "left_anti").join(surface, ["project", "directory"], "left_anti").select("project", "directory", "name")


def in_publishable(files: DataFrame, packages_: DataFrame) -> DataFrame:
    """Files (project, file) whose nearest package is one that others may install: its exports are its surface."""
    from quarry.sources.files import longest_scope

    scoped = longest_scope(files.select("project", "file"), packages_)
    own = packages_.filter("publishable").select("project", F.col("directory").alias("scope"))
    return scoped.join(own, ["project", "scope"], "left_semi").select("project", "file")


def script_globs(files: DataFrame) -> DataFrame:
    """project, file, glob: globs in the scripts of package.json files."""
    read = files.filter(F.col("file").rlike(r"(^|/)package\.json$")).select("project", "file", F.explode(F.map_values(F.coalesce(F.from_json("content", _PACKAGE)["scripts"], F.create_map().cast("map<string,string>")))).alias("script"))
    return read.select("project", "file", F.explode(F.regexp_extract_all("script", F.lit(r"""((?:[\w@.-]+/)*[\w@./-]*\*[\w@./*{},-]*)"""), 1)).alias("glob")).distinct()


_TSCONFIG = "extends string, files array<string>, include array<string>, compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"


def aliases(files: DataFrame) -> DataFrame:
    """project, prefix, target: what an import's beginning stands for.

    From ``paths`` and ``baseUrl`` of tsconfig and jsconfig files, ``alias`` tables of bundlers, the
    names of workspace packages, ``imports`` with ``#`` names, and the module line of go.mod.
    """
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise("")
    in_folder = lambda p: S.normalized(F.concat(folder, F.lit("/"), p))
    no_star = lambda p: F.regexp_replace(p, r"\*.*$", "")
    plain = F.regexp_replace(F.regexp_replace("content", r"(?m)^\s*//.*$|(?s)/\*(?![^\n]*\*\s*\").*?\*/", ""), r",(\s*[}\]])", "$1")
    ts = files.filter(F.col("file").rlike(r"(^|/)[tj]sconfig[\w.]*\.json$")).withColumn("j", F.from_json(plain, _TSCONFIG)).withColumn("_base", F.coalesce("j.compilerOptions.baseUrl", F.lit(".")))
    each = ts.select("project", "file", "_base", F.explode(F.map_entries(F.col("j.compilerOptions.paths"))).alias("e")).select("project", "file", "_base", F.col("e.key").alias("prefix"), F.explode("e.value").alias("target"))
    from_paths = each.select("project", no_star(F.col("prefix")).alias("prefix"), _slashed(in_folder(F.concat(F.col("_base"), F.lit("/"), no_star(F.col("target")))), F.col("target")).alias("target"))
    bundled = files.filter(F.col("file").rlike(r"(^|/)(vite|webpack|rollup|vue|vitest|next|rspack)[\w.]*\.[cm]?[jt]s$"))
    pair = r"""['"]?([@~#\w$/-]+)['"]?\s*:\s*(?:(?:path\.)?(?:resolve|join)\(\s*__dirname\s*,\s*|fileURLToPath\(new URL\(\s*)?['"](\.{0,2}/?[\w./@-]+)['"]"""
    block = F.regexp_extract("content", r"(?s)alias\s*:\s*\{(.*?)\}", 1)
    named = bundled.select("project", "file", F.arrays_zip(F.regexp_extract_all(block, F.lit(pair), 1).alias("prefix"), F.regexp_extract_all(block, F.lit(pair), 2).alias("target")).alias("z"))
    from_bundler = named.select("project", "file", F.explode("z").alias("z")).select("project", F.col("z.prefix").alias("prefix"), in_folder(F.col("z.target")).alias("target"))
    own = packages(files).filter("name IS NOT NULL")
    home = F.when(F.col("directory") == ".", "").otherwise(F.col("directory"))
    started = own.withColumn("_start", F.coalesce(F.get("starts", F.lit(0)), F.lit("index.js")))
    from_names = started.select("project", F.col("name").alias("prefix"), S.normalized(F.concat(home, F.lit("/"), F.col("_start"))).alias("target"))
    below = own.select("project", F.concat("name", F.lit("/")).alias("prefix"), F.concat(home, F.when(home == "", "").otherwise("/")).alias("target"))
    go = files.filter(F.col("file").rlike(r"(^|/)go\.mod$")).select("project", F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("prefix"), folder.alias("target"))
    out = from_paths.unionByName(from_bundler).unionByName(from_names).unionByName(below).unionByName(go)
    return out.filter("prefix <> ''").distinct()


def _slashed(path, given):
    """A directory keeps the slash that ``normalized`` takes away, so that what follows the prefix can be joined on."""
    return F.when(given.rlike(r"/?\*"), F.concat(path, F.lit("/"))).otherwise(path)


def workspace_packages(files: DataFrame) -> DataFrame:
    """project, directory, name of packages that a workspace's globs take in."""
    from quarry.operators.entries import glob_column

    every = packages(files)
    globs = every.select("project", F.col("directory").alias("_root"), F.explode("workspaces").alias("_glob"))
    at = F.when(F.col("_root") == ".", F.col("_glob")).otherwise(F.concat_ws("/", "_root", "_glob"))
    return every.join(globs.withColumn("_glob", at), "project").filter(F.rlike(F.col("directory"), glob_column(F.col("_glob")))).select("project", "directory", "name").distinct()


def project_references(files: DataFrame) -> DataFrame:
    """project, src, dst: directories of .NET projects and of those that they refer to."""
    read = files.filter(F.col("file").rlike(r"\.(cs|fs|vb)proj$"))
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise("")
    named = read.select("project", "file", folder.alias("src"), F.explode(F.regexp_extract_all("content", F.lit(r'<ProjectReference\s+Include="([^"]+)"'), 1)).alias("to"))
    to = S.normalized(F.concat(F.col("src"), F.lit("/"), F.replace("to", F.lit("\\"), F.lit("/"))))
    return named.select("project", "src", F.regexp_replace(to, "/?[^/]*$", "").alias("dst")).distinct()


def build_packages(files: DataFrame) -> DataFrame:
    """project, system, config, package: the members that build files list."""
    rules = (
        ("gradle", r"(^|/)settings\.gradle(\.kts)?$", r"""['"]:([\w:.-]+)['"]"""), ("maven", r"(^|/)pom\.xml$", r"<module>\s*([^<\s]+)\s*</module>"),
        ("go-workspace", r"(^|/)go\.work$", r"(?m)^\s*(?:use\s+)?\./(\S+)"), ("dotnet", r"\.sln$", r'"([^"]+\.(?:cs|fs|vb)proj)"'),
        ("cargo", r"(^|/)Cargo\.toml$", r'(?m)(?:members\s*=\s*\[|^\s*)"([\w./*-]+)"\s*[,\]]'), ("bazel", r"(^|/)BUILD(\.bazel)?$", r'name\s*=\s*"([^"]+)"'),
        ("buck", r"(^|/)BUCK$", r'name\s*=\s*"([^"]+)"'), ("pants", r"(^|/)BUILD$", r'name\s*=\s*"([^"]+)"'),
        ("turborepo", r"(^|/)turbo\.json$", r'"([\w@/#:-]+)"\s*:\s*\{'), ("python", r"(^|/)pyproject\.toml$", r'(?m)^name\s*=\s*"([^"]+)"'),
    )
    none = F.array().cast("array<struct<system:string,package:string>>")
    told = lambda n, p: F.transform(F.regexp_extract_all("content", F.lit(p), 1), lambda x: F.struct(F.lit(n).alias("system"), F.replace(x, F.lit(":"), F.lit("/")).alias("package")))
    found = F.concat(*(F.when(F.col("file").rlike(where), told(n, p)).otherwise(none) for n, where, p in rules))
    return files.select("project", F.col("file").alias("config"), F.explode(found).alias("e")).select("project", "e.system", "config", "e.package").distinct()


def lockfile(files: DataFrame) -> DataFrame:
    """project, name, version, license and the requirer of each dependency in package-lock.json files."""
    schema = "packages map<string,struct<version:string,license:string,dependencies:map<string,string>>>"
    read = files.filter(F.col("file").rlike(r"(^|/)package-lock\.json$")).select("project", F.explode(F.from_json("content", schema)["packages"]).alias("path", "p"))
    name = F.regexp_replace("path", r"^.*node_modules/", "")
    return read.filter("path <> ''").select("project", name.alias("name"), "p.version", "p.license", F.map_keys(F.coalesce("p.dependencies", F.create_map().cast("map<string,string>"))).alias("requires"))
