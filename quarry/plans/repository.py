"""Queries over repositories made from the test tables: their files are texts built from rows, so every fact in them is known to SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import assets, duplicates, entries, functions, graph, history
from quarry.plans import scan
from quarry.plans.queries import _ASSET_SQL, _asset_rows, as_long, query
from quarry.plans.tables import EDGES_SQL, REACHED_SQL, part_edges, part_seeds, table
from quarry.shared import written
from quarry.sources import code, configs, parse, sql
from quarry.sources import files as sources



def _p() -> F.Column:
    return F.lit("p").alias("project")


def _text(c) -> F.Column:
    return c.cast("string") if isinstance(c, F.Column) else F.col(c).cast("string")


def _cat(*parts) -> F.Column:
    return F.concat(*(x if isinstance(x, F.Column) else F.lit(x) for x in parts))


def _lines(column, order) -> F.Column:
    """The lines of a group, one below the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), column.alias("l")))), lambda x: x["l"]), "\n")


def _number(path: str, pattern: str) -> F.Column:
    return F.regexp_extract(path, pattern, 1).cast("long")


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """n, r: every nation with its region, as texts."""
    return table(spark, d, "nation").select(_text("n_nationkey").alias("n"), _text("n_regionkey").alias("r"))


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    """s, n, r: every supplier with its nation and region, as texts."""
    own = table(spark, d, "supplier").select(_text("s_suppkey").alias("s"), _text("s_nationkey").alias("n"))
    return own.join(_regions(spark, d), "n").select("s", "n", "r")


_SUPPLIERS_SQL = "s AS (SELECT s_suppkey AS s, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """A script for every part: it imports the parts that follow it, exports two functions and keeps one to itself.

    Every third script calls its own function; of every fourth, a note names the second export.
    """
    k = _text("p_partkey")
    folder = lambda c: _text(c.cast("long") % 7)
    part = table(spark, d, "part").select(k.alias("k"), F.col("p_partkey"))
    edges = part_edges(spark, d).select("src", "dst").distinct()
    line = _cat("import { f", F.col("dst"), " } from '../m", folder(F.col("dst")), "/p", F.col("dst"), ".js';")
    heads = edges.groupBy(F.col("src").alias("k")).agg(_lines(line, F.col("dst")).alias("head"))
    call = F.when(F.col("p_partkey") % 3 == 0, _cat("g", F.col("k"), "();\n")).otherwise("")
    body = _cat("\nexport function f", F.col("k"), "() { return 1; }\nexport function h", F.col("k"), "() { return '}'; }\nfunction g", F.col("k"), "() {\n  return g", F.col("k"), ";\n}\n", call)
    rows = part.join(heads, "k", "left").select(_p(), _cat("src/m", folder(F.col("p_partkey")), "/p", F.col("k"), ".js").alias("file"), F.concat(F.coalesce("head", F.lit("")), body).alias("content"))
    # Every step that reads the files would make them anew, which sorts all lines of all orders.
    return written(rows.withColumn("lang", F.lit("javascript")), "modules", once=True)


def _parsed(files: DataFrame) -> DataFrame:
    """What files parse to, made once for all steps that read it."""
    return written(parse.parsed(files), "parsed", once=True)


def _notes(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "part").filter("p_partkey % 4 = 0")
    return own.select(_p(), _cat("src/notes/n", _text("p_partkey"), ".js").alias("file"), _cat("// h", _text("p_partkey"), " is used elsewhere\n").alias("content"), F.lit("javascript").alias("lang"))


# --- scripts: parsing, resolution, dead code -------------------------------------------------------------


@query(f"WITH {EDGES_SQL.strip()} SELECT src, dst FROM edges WHERE src <> dst")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    files = _modules(spark, d)
    found = code.resolved(parse.imports(_parsed(files)), files)
    return found.select(_number("src", r"p(\d+)\.js$").alias("src"), _number("dst", r"p(\d+)\.js$").alias("dst"))


@query(f"WITH {EDGES_SQL.strip()} SELECT src AS file, 'f' || dst AS name, '../m' || (dst % 7) || '/p' || dst || '.js' AS module FROM edges")
def parsed_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = parse.imports(parse.parsed(_modules(spark, d)))
    return rows.select(_number("file", r"p(\d+)\.js$").alias("file"), F.explode("specifiers").alias("s"), "module").select("file", F.col("s.name").alias("name"), "module")


@query("SELECT p_partkey AS file, unnest(['f', 'h']) || p_partkey AS name FROM part")
def parsed_exports(spark: SparkSession, d: str) -> DataFrame:
    rows = parse.exports(parse.parsed(_modules(spark, d)))
    return rows.select(_number("file", r"p(\d+)\.js$").alias("file"), "name")


@query(f"""WITH {EDGES_SQL.strip()}, n AS (SELECT p_partkey AS k, (SELECT count(*) FROM edges WHERE src = p_partkey) AS imports FROM part)
SELECT k AS file, unnest(['f', 'g', 'h']) || k AS name, CAST(greatest(imports, 1) + unnest([1, 3, 2]) AS BIGINT) AS line, CAST(greatest(imports, 1) + unnest([1, 5, 2]) AS BIGINT) AS end_line, unnest([true, false, true]) AS exported FROM n""")
def parsed_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = parse.functions(parse.parsed(_modules(spark, d)))
    return rows.select(_number("file", r"p(\d+)\.js$").alias("file"), "name", as_long("line"), as_long("end_line"), "exported")


@query("""WITH n AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 5 AS m FROM part)
SELECT k AS file, unnest(['a', 'run', 'in', 'z']) || CASE WHEN generate_subscripts([1, 2, 3, 4], 1) = 2 THEN '' ELSE '' || k END AS name,
  unnest(['arrow', 'method', 'method', 'function']) AS type, CAST(n + unnest([1, 3, 5 + m, 9 + m]) AS BIGINT) AS line, CAST(n + unnest([1, 6 + m, 5 + m, 10 + m]) AS BIGINT) AS end_line,
  unnest([NULL, 'C' || k, NULL, NULL]) AS class_name FROM n""")
def nested_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Templates in templates, braces in patterns, markup and comments, and methods of objects in methods of classes: where each declaration begins and ends."""
    part = table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    pad, filler = F.repeat(F.lit("// } `\n"), F.col("p_size")), F.repeat(F.lit("    s = s / 2; // {\n"), (F.col("p_partkey") % 5).cast("int"))
    content = _cat(
        pad, "export const a", F.col("k"), " = (x) => `${x ? `}` : '{'}`;\n", "class C", F.col("k"), " extends mix({ a: 1 }) {\n  run(s) {\n    if (s) /[/}]/.exec(s);\n", filler,
        "    return { in", F.col("k"), "() { return '}'; } };\n  }\n}\nconst v = <div a=\"}\">{(y) => '{'}don't</div>;\nfunction z", F.col("k"), "() {\n}\n",
    )
    files = part.select(_p(), _cat("src/p", F.col("k"), ".jsx").alias("file"), content.alias("content"), F.lit("javascript").alias("lang"))
    rows = parse.functions(parse.parsed(files))
    return rows.select(_number("file", r"p(\d+)\.jsx$").alias("file"), "name", "type", as_long("line"), as_long("end_line"), "class_name")


@query("""WITH n AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 3 AS m FROM part)
SELECT k AS file, unnest(['top', '_own', 'inner', 'late', 'K', 'meth', '_hid']) || k AS name, unnest(['function', 'function', 'function', 'function', 'class', 'method', 'method']) AS type,
  CAST(n + unnest([3, 8, 9, 13, 14, 17, 20]) AS BIGINT) AS line, CAST(n + unnest([6, 11, 10, 13, 22, 18, 22]) AS BIGINT) AS end_line,
  unnest([NULL, NULL, NULL, NULL, NULL, 'K' || k, 'K' || k]) AS class_name,
  unnest([true, m = 1, false, m <> 1, true, false, false]) AS exported FROM n WHERE m <> 2
UNION ALL SELECT k, 'SyntaxError', 'error', CAST(n + 1 AS BIGINT), CAST(n + 1 AS BIGINT), NULL, false FROM n WHERE m = 2
UNION ALL SELECT k, 'f' || k, 'function', CAST(n + 2 AS BIGINT), CAST(n + 3 AS BIGINT), NULL, true FROM n WHERE m = 2""")
def python_declarations(spark: SparkSession, d: str) -> DataFrame:
    """Conditional, nested and decorated definitions, definitions inside texts, ``__all__``, and files of another version's syntax."""
    part = table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    k, pad = F.col("k"), F.repeat(F.lit("# def no():\n"), F.col("p_size"))
    names = F.when(F.col("p_partkey") % 3 == 1, _cat("__all__ = ['top", k, "'] + ['_own", k, "', 'K", k, "']")).otherwise("import os.path")
    whole = _cat(
        pad, names, "\n@wraps(x)\nasync def top", k, "(a=(\n  1)):\n    '''\ndef no(): pass'''\n\ndef _own", k, "():\n    def inner", k, "(b):\n        return b\n    return inner", k,
        "\nif True:\n    def late", k, "(): pass\nclass K", k, ":\n    x = 1\n    @property\n    def meth", k, "(self):\n        return 1\n    # end\n    def _hid", k, "(self):\n        if x:\n            return '}'\n",
    )
    broken = _cat(pad, "print 'two'\ndef f", k, "():\n    return 1\n")
    content = F.when(F.col("p_partkey") % 3 == 2, broken).otherwise(whole)
    files = part.select(_p(), _cat("src/p", k, ".py").alias("file"), content.alias("content"), F.lit("python").alias("lang"))
    rows = parse.parsed(files).filter("relation IN ('function', 'class', 'error')")
    name = F.when(F.col("relation") == "error", F.col("type")).otherwise(F.col("name"))
    kind = F.when(F.col("relation") == "error", "error").otherwise(F.col("type"))
    return rows.select(_number("file", r"p(\d+)\.py$").alias("file"), name.alias("name"), kind.alias("type"), as_long("line"), as_long("end_line"), "class_name", "exported")


@query(f"""WITH {EDGES_SQL.strip()}, n AS (SELECT p_partkey AS k, (SELECT count(*) FROM edges WHERE src = p_partkey) AS imports FROM part)
SELECT k AS file, unnest(['f', 'g', 'h']) || k AS name, CAST(greatest(imports, 1) + unnest([1, 3, 2]) AS BIGINT) AS line FROM n""")
def functions_from_sql(spark: SparkSession, d: str) -> DataFrame:
    """The readers as a table function in a SQL query."""
    sql.register(spark)
    _modules(spark, d).createOrReplaceTempView("quarry_modules")
    rows = spark.sql("SELECT file, name, line FROM parse_code(TABLE(quarry_modules) PARTITION BY (project, file)) WHERE relation = 'function'")
    return rows.select(_number("file", r"p(\d+)\.js$").alias("file"), "name", as_long("line"))


@query("SELECT 'parsed' AS status, count(*) AS files FROM part UNION ALL SELECT 'empty', count(*) FROM part WHERE p_partkey % 4 = 0")
def parse_status(spark: SparkSession, d: str) -> DataFrame:
    files = _modules(spark, d).unionByName(_notes(spark, d))
    return parse.status(parse.parsed(files), files).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT p_partkey AS file, 'g' || p_partkey AS name FROM part WHERE p_partkey % 3 <> 0")
def dead_functions(spark: SparkSession, d: str) -> DataFrame:
    files = _modules(spark, d)
    return functions.dead(parse.functions(_parsed(files)), files).select(_number("file", r"p(\d+)\.js$").alias("file"), "name")


@query("SELECT p_partkey AS file, 'g' || p_partkey AS name, 'file' AS scope FROM part")
def eligible_functions(spark: SparkSession, d: str) -> DataFrame:
    files = _modules(spark, d)
    return functions.eligible(parse.functions(_parsed(files)), files).select(_number("file", r"p(\d+)\.js$").alias("file"), "name", "scope")


@query(REACHED_SQL + " SELECT p_partkey AS file FROM part WHERE p_partkey NOT IN (SELECT node FROM reached)")
def scan_dead_files(spark: SparkSession, d: str) -> DataFrame:
    start = table(spark, d, "part").filter("p_partkey % 100 = 0").select(_p(), _cat("src/m", _text(F.col("p_partkey") % 7), "/p", _text("p_partkey"), ".js").alias("file"), F.lit("given").alias("reason"))
    found = scan.analyse(_modules(spark, d).drop("lang"), start)
    return found.dead_files.select(_number("node", r"p(\d+)\.js$").alias("file"))


@query(REACHED_SQL + """, used AS (SELECT DISTINCT e.dst FROM edges e JOIN reached r ON e.src = r.node)
SELECT dst AS file, 'h' || dst AS name FROM used WHERE dst % 4 <> 0 AND dst % 100 <> 0""")
def scan_dead_exports(spark: SparkSession, d: str) -> DataFrame:
    start = table(spark, d, "part").filter("p_partkey % 100 = 0").select(_p(), _cat("src/m", _text(F.col("p_partkey") % 7), "/p", _text("p_partkey"), ".js").alias("file"), F.lit("given").alias("reason"))
    found = scan.analyse(_modules(spark, d).unionByName(_notes(spark, d)).drop("lang"), start)
    return found.dead_exports.select(_number("file", r"p(\d+)\.js$").alias("file"), F.explode("dead_names").alias("name"))


@query(REACHED_SQL + " SELECT p_partkey AS node, CASE WHEN regexp_matches(lower(p_name), 'plugin|middleware|handler|hook|extension|addon|adapter|driver|strategy|provider') THEN 'possibly-live' ELSE 'unreachable' END AS verdict, CASE WHEN p_size >= 43 THEN 'high' WHEN p_size >= 30 THEN 'medium' ELSE 'low' END AS label FROM part WHERE p_partkey NOT IN (SELECT node FROM reached)")
def dead_verdicts(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").select(_p(), _text("p_partkey").alias("node"), "p_name", "p_size")
    seeds = part_seeds(spark, d)
    dead = graph.not_reached(nodes, graph.reachable(part_edges(spark, d), seeds), seeds)
    return dead.select(as_long("node"), graph.verdict(F.col("p_name")).alias("verdict"), graph.confidence_label(F.col("p_size") / 50.0).alias("label"))


@query(REACHED_SQL + " SELECT DISTINCT e.src AS importer, e.dst AS target, CASE e.src % 3 WHEN 0 THEN 'default' WHEN 1 THEN '*' ELSE 'f' || e.dst END AS symbol FROM edges e JOIN reached r ON e.src = r.node")
def export_usage(spark: SparkSession, d: str) -> DataFrame:
    edges = part_edges(spark, d).distinct()
    kind = F.when(F.col("src").cast("long") % 3 == 0, "default").when(F.col("src").cast("long") % 3 == 1, "namespace").otherwise("named")
    named = F.struct(_cat("f", F.col("dst")).alias("name"), _cat("f", F.col("dst")).alias("local_name"), kind.alias("type"))
    imports = edges.select("project", F.col("src").alias("file"), F.col("dst").alias("target"), F.lit("esm").alias("type"), F.array(named).alias("specifiers"))
    found = graph.export_usage(graph.reachable(part_edges(spark, d), part_seeds(spark, d)), imports)
    return found.select(as_long("importer"), as_long("target"), "symbol").distinct()


@query("""WITH RECURSIVE m AS (SELECT s_suppkey AS s, s_nationkey AS n FROM supplier) SELECT s AS node FROM m WHERE n IN (SELECT n FROM m WHERE s = 1)""")
def same_scope(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "supplier").select(_p(), _text("s_suppkey").alias("node"), _text("s_nationkey").alias("scope"))
    seed = members.filter("node = '1'").select("project", "node")
    return graph.reachable(graph.shared_scope_edges(members), seed).filter("node NOT LIKE 'scope:%'").select(as_long("node"))


@query("""SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 5 <> 4 AND s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 10 = 1)
UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 1""")
def package_scope(spark: SparkSession, d: str) -> DataFrame:
    """Java and Kotlin files of one package in three source roots, of which some name it and some only lie there; old classes are left out."""
    k = F.col("s_suppkey")
    root = F.when(k % 3 == 0, "app/src/main/java").when(k % 3 == 1, "app/src/test/java").otherwise("lib/src/main/kotlin")
    name = F.when(k % 5 == 4, "Legacy").otherwise("")
    file = _cat(root, "/org/n", _text("s_nationkey"), "/", name, "S", _text(k), F.when(k % 2 == 0, ".kt").otherwise(".java"))
    content = F.when(k % 7 == 0, "class X {}").otherwise(_cat("// c\npackage org.n", _text("s_nationkey"), F.when(k % 2 == 0, "").otherwise(";"), "\n"))
    files = table(spark, d, "supplier").select(_p(), file.alias("file"), content.alias("content"), F.when(k % 2 == 0, "kotlin").otherwise("java").alias("lang"), (k % 10 == 1).alias("start"))
    seeds = files.filter("start").select("project", F.col("file").alias("node"))
    reached = graph.reachable(scan.implicit_edges(files), seeds)
    return reached.filter("node NOT LIKE 'scope:%'").select(_number("node", r"S(\d+)\.\w+$").alias("node"))


@query("SELECT p_partkey AS file FROM part WHERE p_partkey % 7 IN (2, 3)")
def glob_seeds(spark: SparkSession, d: str) -> DataFrame:
    globs = spark.createDataFrame([("p", "src/load.js", "./m2/**/*.js"), ("p", "src/load.js", "m3/p*.js"), ("p", "src/load.js", "./m4/*.ts")], "project string, file string, glob string")
    return graph.glob_seeds(_modules(spark, d), globs).select(_number("node", r"p(\d+)\.js$").alias("file"))


# --- other languages, aliases, packages ---------------------------------------------------------------------


@query(f"WITH {_SUPPLIERS_SQL} SELECT s.s AS supplier, n_nationkey AS nation FROM s JOIN nation ON n_regionkey = s.r")
def go_edges(spark: SparkSession, d: str) -> DataFrame:
    nations = _regions(spark, d).select(_p(), _cat("pkg/r", F.col("r"), "/n", F.col("n"), ".go").alias("file"), _cat("package r", F.col("r"), "\n").alias("content"))
    mains = _suppliers(spark, d).select(_p(), _cat("cmd/s", F.col("s"), "/run.go").alias("file"), _cat('package main\n\nimport "example.com/app/pkg/r', F.col("r"), '"\n').alias("content"))
    files = nations.unionByName(mains).withColumn("lang", F.lit("go"))
    found = code.resolved(code.imports(files), files)
    return found.select(_number("src", r"s(\d+)/run\.go$").alias("supplier"), _number("dst", r"n(\d+)\.go$").alias("nation"))


@query("SELECT c_custkey AS customer, c_nationkey AS nation FROM customer")
def python_edges(spark: SparkSession, d: str) -> DataFrame:
    nations = _regions(spark, d).select(_p(), _cat("lib/shop/models/n", F.col("n"), ".py").alias("file"), F.lit("class N:\n    pass\n").alias("content"))
    own = table(spark, d, "customer").select(_p(), _cat("app/c", _text("c_custkey"), ".py").alias("file"), _cat("import os\nfrom shop.models import n", _text("c_nationkey"), "\n").alias("content"))
    files = nations.unionByName(own).withColumn("lang", F.lit("python"))
    found = code.resolved(parse.imports(parse.parsed(files)), files)
    return found.select(_number("src", r"c(\d+)\.py$").alias("customer"), _number("dst", r"n(\d+)\.py$").cast("int").alias("nation"))


@query("SELECT s_suppkey AS supplier, s_nationkey AS nation FROM supplier")
def java_edges(spark: SparkSession, d: str) -> DataFrame:
    nations = _regions(spark, d).select(_p(), _cat("core/src/main/java/com/shop/N", F.col("n"), ".java").alias("file"), F.lit("").alias("content"))
    own = _suppliers(spark, d).select(_p(), _cat("web/src/main/java/com/web/S", F.col("s"), ".java").alias("file"), _cat("import java.util.List;\nimport com.shop.N", F.col("n"), ";\n").alias("content"))
    files = nations.unionByName(own).withColumn("lang", F.lit("java"))
    found = code.resolved(code.imports(files), files)
    return found.select(_number("src", r"S(\d+)\.java$").alias("supplier"), _number("dst", r"N(\d+)\.java$").cast("int").alias("nation"))


@query("SELECT s_suppkey AS supplier, s_nationkey AS nation FROM supplier")
def alias_edges(spark: SparkSession, d: str) -> DataFrame:
    config = spark.createDataFrame([("p", "tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"@n/*": ["src/nations/*"]}}}')], "project string, file string, content string")
    nations = _regions(spark, d).select(_p(), _cat("src/nations/n", F.col("n"), ".ts").alias("file"), F.lit("").alias("content"))
    own = _suppliers(spark, d).select(_p(), _cat("src/s", F.col("s"), ".ts").alias("file"), _cat("import x from '@n/n", F.col("n"), "';\nimport y from 'react';\n").alias("content"))
    files = nations.unionByName(own).withColumn("lang", F.lit("javascript"))
    found = code.resolved(code.imports(files), files, configs.aliases(files.drop("lang").unionByName(config)))
    return found.select(_number("src", r"s(\d+)\.ts$").alias("supplier"), _number("dst", r"n(\d+)\.ts$").cast("int").alias("nation"))


def _packages(spark: SparkSession, d: str) -> DataFrame:
    """A package for each region, and below it one for each nation with an even number; regions with an odd number are private."""
    regions = table(spark, d, "region").select(_p(), _cat("r", _text("r_regionkey"), "/package.json").alias("file"), _cat('{"name": "r', _text("r_regionkey"), '", "main": "index.js", "private": ', F.when(F.col("r_regionkey") % 2 == 1, "true").otherwise("false"), "}").alias("content"))
    even = _regions(spark, d).filter("CAST(n AS INT) % 2 = 0")
    return regions.unionByName(even.select(_p(), _cat("r", F.col("r"), "/n", F.col("n"), "/package.json").alias("file"), _cat('{"name": "n', F.col("n"), '", "private": true}').alias("content")))


def _customer_files(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select("c_custkey", _text("c_nationkey").alias("n")).join(_regions(spark, d), "n")
    return own.select(_p(), _cat("r", F.col("r"), "/n", F.col("n"), "/c", _text("c_custkey"), ".js").alias("file"))


_CUSTOMERS_SQL = "c AS (SELECT c_custkey AS customer, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH {_CUSTOMERS_SQL} SELECT customer, 'r' || r || CASE WHEN n % 2 = 0 THEN '/n' || n ELSE '' END AS scope FROM c")
def nearest_package(spark: SparkSession, d: str) -> DataFrame:
    found = sources.longest_scope(_customer_files(spark, d), configs.packages(_packages(spark, d)))
    return found.select(_number("file", r"c(\d+)\.js$").alias("customer"), "scope")


@query(f"WITH {_CUSTOMERS_SQL} SELECT customer FROM c WHERE n % 2 = 1 AND r % 2 = 0")
def publishable_files(spark: SparkSession, d: str) -> DataFrame:
    found = configs.in_publishable(_customer_files(spark, d), configs.packages(_packages(spark, d)))
    return found.select(_number("file", r"c(\d+)\.js$").alias("customer"))


@query("SELECT DISTINCT l_suppkey AS requirer, 'p' || l_partkey AS name, 'dependencies' AS declared_in FROM lineitem")
def manifest_dependencies(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    held = F.concat(F.lit('{"dependencies": {'), F.array_join(F.collect_list(_cat('"p', _text("l_partkey"), '": "^1.0.0"')), ", "), F.lit("}}"))
    files = lines.groupBy("l_suppkey").agg(held.alias("content")).select(_p(), _cat("s", _text("l_suppkey"), "/package.json").alias("file"), "content")
    return configs.manifests(files).select(_number("directory", r"^s(\d+)$").alias("requirer"), "name", "declared_in")


@query("SELECT 's' || s_suppkey AS name, '1.' || s_nationkey || '.0' AS version, CASE WHEN s_nationkey % 2 = 0 THEN 'MIT' ELSE 'GPL-3.0' END AS license FROM supplier")
def lockfile_packages(spark: SparkSession, d: str) -> DataFrame:
    one = _cat('"node_modules/s', _text("s_suppkey"), '": {"version": "1.', _text("s_nationkey"), '.0", "license": "', F.when(F.col("s_nationkey") % 2 == 0, "MIT").otherwise("GPL-3.0"), '"}')
    content = F.concat(F.lit('{"packages": {"": {}, '), F.array_join(F.collect_list(one), ", "), F.lit("}}"))
    files = table(spark, d, "supplier").groupBy("s_nationkey").agg(content.alias("content")).select(_p(), _cat("n", _text("s_nationkey"), "/package-lock.json").alias("file"), "content")
    return configs.lockfile(files).select("name", "version", "license")


@query("SELECT 'r' || n_regionkey || '/webpack.config.js' AS config, 'src/n' || n_nationkey || '.js' AS path, 'webpack' AS reader FROM nation")
def config_entries(spark: SparkSession, d: str) -> DataFrame:
    entry = F.concat(F.lit("module.exports = { entry: { "), F.array_join(F.collect_list(_cat("a", F.col("n"), ": './src/n", F.col("n"), ".js'")), ", "), F.lit(" } }"))
    files = _regions(spark, d).groupBy("r").agg(entry.alias("content")).select(_p(), _cat("r", F.col("r"), "/webpack.config.js").alias("file"), "content")
    return configs.entries(files).select("config", "path", "reader")


@query("SELECT 'scripts/s' || s_suppkey || '.js' AS path FROM supplier")
def script_entries(spark: SparkSession, d: str) -> DataFrame:
    one = _cat('"run', F.col("s"), '": "node scripts/s', F.col("s"), '.js --fast"')
    files = _suppliers(spark, d).groupBy("n").agg(F.concat(F.lit('{"scripts": {'), F.array_join(F.collect_list(one), ", "), F.lit("}}")).alias("content")).select(_p(), _cat("n", F.col("n"), "/package.json").alias("file"), "content")
    return configs.entries(files).filter("reader = 'scripts'").select("path")


@query("SELECT 'maven' AS system, 'r' || n_regionkey || '/pom.xml' AS config, 'n' || n_nationkey AS package FROM nation")
def build_packages(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat(F.lit("<project><modules>"), F.array_join(F.collect_list(_cat("<module>n", F.col("n"), "</module>")), "\n"), F.lit("</modules></project>"))
    files = _regions(spark, d).groupBy("r").agg(content.alias("content")).select(_p(), _cat("r", F.col("r"), "/pom.xml").alias("file"), "content")
    return configs.build_packages(files).select("system", "config", "package")


@query("SELECT CASE n_nationkey % 4 WHEN 0 THEN 'cargo' WHEN 1 THEN 'maven' WHEN 2 THEN 'turborepo' ELSE 'go-workspace' END AS system, 'n' || n_nationkey AS directory FROM nation")
def build_systems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, "Cargo.toml").when(k == 1, "pom.xml").when(k == 2, "turbo.json").otherwise("go.work")
    files = table(spark, d, "nation").select(_p(), _cat("n", _text("n_nationkey"), "/", name).alias("file"), F.lit("").alias("content"))
    return configs.build_systems(files).select("system", "directory")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation), r(n) AS (SELECT 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.n) SELECT n AS node FROM r""")
def project_closure(spark: SparkSession, d: str) -> DataFrame:
    to = _text((F.col("n_nationkey") * 3 + 1) % 25)
    include = _cat('<Project><ProjectReference Include="..\\n', to, "\\n", to, '.csproj" /></Project>')
    files = table(spark, d, "nation").select(_p(), _cat("n", _text("n_nationkey"), "/n", _text("n_nationkey"), ".csproj").alias("file"), include.alias("content"))
    seed = spark.createDataFrame([("p", "n0")], "project string, node string")
    return graph.reachable(configs.project_references(files), seed).select(_number("node", r"^n(\d+)$").cast("int").alias("node"))


@query("SELECT n_nationkey AS nation, 'n' || n_nationkey AS name FROM nation WHERE n_regionkey < 3")
def workspace_members(spark: SparkSession, d: str) -> DataFrame:
    root = spark.createDataFrame([("p", "package.json", '{"private": true, "workspaces": ["r0/*", "r1/*", "r2/*"]}')], "project string, file string, content string")
    own = _regions(spark, d).select(_p(), _cat("r", F.col("r"), "/n", F.col("n"), "/package.json").alias("file"), _cat('{"name": "n', F.col("n"), '"}').alias("content"))
    return configs.workspace_packages(root.unionByName(own)).select(_number("directory", r"n(\d+)$").cast("int").alias("nation"), "name")


@query("SELECT n_nationkey AS nation FROM nation WHERE n_nationkey % 5 = 4 AND n_nationkey <> 9")
def abandoned_packages(spark: SparkSession, d: str) -> DataFrame:
    """By nation: a package with a start, one with a script, one that another needs, one that needs another, and one without any; 9 is needed by the root."""
    k = F.col("n_nationkey") % 5
    name = _cat('{"name": "n', _text("n_nationkey"), '"')
    rest = F.when(k == 0, ', "main": "index.js"}').when(k == 1, ', "scripts": {"dev": "x"}}').when(k == 3, _cat(', "dependencies": {"n', _text(F.col("n_nationkey") - 1), '": "*"}}')).otherwise("}")
    files = table(spark, d, "nation").select(_p(), _cat("packages/n", _text("n_nationkey"), "/package.json").alias("file"), F.concat(name, rest).alias("content"))
    root = spark.createDataFrame([("p", "package.json", '{"name": "root", "private": true, "devDependencies": {"n9": "*", "react": "1"}}')], "project string, file string, content string")
    return configs.abandoned(files.unionByName(root)).select(_number("directory", r"n(\d+)$").cast("int").alias("nation"))


@query("SELECT p_partkey AS file, 'g' || p_partkey AS name, CAST(2 * length(p_partkey::VARCHAR) + 28 AS INTEGER) AS size FROM part")
def function_sizes(spark: SparkSession, d: str) -> DataFrame:
    files = _modules(spark, d)
    found = functions.with_code(parse.functions(parse.parsed(files)).filter("NOT exported"), files)
    return found.select(_number("file", r"p(\d+)\.js$").alias("file"), "name", "size")


@query("WITH c AS (SELECT p_size % 5 AS v, p_brand AS file, min(p_partkey) AS k FROM part GROUP BY ALL) SELECT v AS variable, count(*) AS copies FROM c GROUP BY 1 HAVING count(*) > 1")
def duplicate_functions(spark: SparkSession, d: str) -> DataFrame:
    """Code that differs in comments, texts, numbers and spacing only is the same code."""
    v = _text(F.col("p_size") % 5)
    text = _cat("function a() {\n  // of ", _text("p_partkey"), "\n  let v", v, F.when(F.col("p_partkey") % 2 == 0, " = ").otherwise("="), _text("p_partkey"), " + 'x", _text("p_partkey"), "'; return v", v, "}")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), F.md5(duplicates.normalized_code(text).cast("binary")).alias("hash"), F.lit(100).alias("size"), F.col("p_size"))
    per = duplicates.largest_first(duplicates.exact_groups(rows))
    return per.join(rows.select("hash", (F.col("p_size") % 5).alias("variable")).distinct(), "hash").select("variable", "copies")


@query("SELECT n_nationkey AS nation, 'src/n' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.ts' ELSE '/index.js' END AS file FROM nation")
def workspace_exports(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "nation").select("n_nationkey", _text("n_nationkey").alias("n"))
    packages = own.select(_p(), F.lit(".").alias("directory"), _cat("./dist/n", F.col("n"), ".js").alias("path"))
    files = own.select(_p(), _cat("src/n", F.col("n"), F.when(F.col("n_nationkey") % 2 == 0, ".ts").otherwise("/index.js")).alias("file"))
    found = entries.workspace_exports(packages, files)
    return found.select(_number("path", r"n(\d+)\.js$").cast("int").alias("nation"), "file")


@query("SELECT c_custkey AS file, c_nationkey AS type FROM customer WHERE c_nationkey % 3 <> 0")
def type_references(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "customer").select(_p(), _text("c_custkey").alias("file"), _cat("var x = new Nation", _text("c_nationkey"), "Service(y);").alias("content"))
    types = table(spark, d, "nation").filter("n_nationkey % 3 <> 0").select(_p(), _cat("n", _text("n_nationkey")).alias("file"), _cat("Nation", _text("n_nationkey"), "Service").alias("name"))
    return entries.type_references(files, types).select(F.col("src").cast("long").alias("file"), _number("dst", r"^n(\d+)$").cast("int").alias("type"))


# --- files: what a scan covers, kinds, entry points ------------------------------------------------------------

_PATHS = ("src/a/f{}.ts", "node_modules/x/f{}.js", "lib/f{}.py", "docs/img/f{}.png", "third_party/f{}.c", "test-fixtures/f{}.rb", "styles/f{}.scss", "pkg/f{}.min.js", "src/f{}.kt", "media/f{}.mp4", "app/f{}.svelte", "data/f{}.sqlite")


def _paths(spark: SparkSession, d: str, paths: tuple[str, ...] = _PATHS) -> DataFrame:
    """A file for every document, whose path is one of several in turn."""
    k = F.col("doc_id") % len(paths)
    path = F.lit(None).cast("string")
    for i, p in enumerate(paths):
        head, tail = p.split("{}")
        path = F.when(k == i, _cat(head, _text("doc_id"), tail)).otherwise(path)
    return table(spark, d, "documents").select(_p(), path.alias("file"), "doc_id", F.col("n_chars").alias("size"), F.col("text").alias("content"), "lang")


def _paths_sql(values: list, paths: tuple[str, ...] = _PATHS) -> str:
    return f"CASE doc_id % {len(paths)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query(f"SELECT {_paths_sql(['true' if i in (1, 4, 7, 9, 11) else 'false' for i in range(12)])} AS scan, {_paths_sql(['true' if i in (1, 5, 7, 11) else 'false' for i in range(12)])} AS cli, count(*) AS files FROM documents GROUP BY ALL")
def excluded_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _paths(spark, d).select(sources.excluded(F.col("file")).alias("scan"), sources.excluded(F.col("file"), "cli").alias("cli"))
    return rows.groupBy("scan", "cli").agg(F.count(F.lit(1)).alias("files"))


_KINDS = ["javascript", "javascript", "python", "assets", "other", "ruby", "css", "javascript", "kotlin", "other", "javascript", "other"]


@query(f"SELECT {_paths_sql([repr(k) for k in _KINDS])} AS category, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY 1")
def file_categories(spark: SparkSession, d: str) -> DataFrame:
    return sources.histogram(_paths(spark, d).drop("lang"), sources.category(F.col("file")), leave=None).withColumnRenamed("lang", "category")


_SPOKEN = ["javascript", "javascript", "python", "other", "other", "ruby", "other", "javascript", "java", "other", "other", "other"]


@query(f"WITH c AS (SELECT {_paths_sql([repr(k) for k in _SPOKEN])} AS lang, n_chars FROM documents) SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size FROM c WHERE lang <> 'other' GROUP BY 1")
def cli_languages(spark: SparkSession, d: str) -> DataFrame:
    return sources.histogram(_paths(spark, d).drop("lang"), sources.cli_language(F.col("file")))


_REGISTRY = ["'javascript'", "'javascript'", "'python'", "NULL", "'cpp'", "'ruby'", "NULL", "'javascript'", "'kotlin'", "NULL", "NULL", "NULL"]


@query(f"SELECT doc_id, {_paths_sql(_REGISTRY)} AS language, {_paths_sql([repr(x) for x in ('ts', 'js', 'py', 'other', 'other', 'other', 'other', 'js', 'other', 'other', 'js', 'other')])} AS rules FROM documents")
def registry_languages(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("doc_id", sources.language(F.col("file")).alias("language"), sources.rule_language(F.col("file")).alias("rules"))


_MADE = ("src/a/f{}.ts", "src/generated/f{}.ts", "api/f{}_pb2.py", "api/f{}.pb.go", "web/f{}.g.cs", "obj/f{}.cs", "src/mock_f{}.go")


@query(f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN lang = 'en' ELSE true END AS generated FROM documents")
def generated_files(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("lang") == "en", "// Code generated by a tool. DO NOT EDIT\n").otherwise("// by hand\n")
    return _paths(spark, d, _MADE).select("doc_id", sources.generated(F.col("file"), F.concat(head, F.lit("x = 1"))).alias("generated"))


_STARTS = ("src/core/x{}.ts", "src/core/x{}.test.ts", "scripts/x{}.js", "types/x{}.d.ts", "app/pages/x{}.tsx", "plugins/x{}.js", "src/dead-x{}.test.js", "locales/x{}.js", "x{}.config.js", "src/unused_x/migrations/x{}.js")
_REASONS = ["NULL", "'test'", "'command'", "'types'", "'pages'", "'plugin'", "NULL", "'locale'", "'config'", "NULL"]


@query(f"SELECT doc_id, {_paths_sql(_REASONS, _STARTS)} AS reason FROM documents")
def entry_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d, _STARTS).select("doc_id", code.entry_reason(F.col("file")).alias("reason"))


@query("SELECT doc_id, doc_id % 12 IN (0, 1, 2, 4, 5, 7, 8, 10) AS is_source FROM documents")
def source_files(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("doc_id", history.is_source(F.col("file")).alias("is_source"))


_CONSOLE = ("src/components/f{}.js", "src/server/f{}.js", "src/pages/f{}.test.js", "src/ui/f{}.component.ts", "public/x/f{}.js", "web/public/f{}.mjs")


@query("SELECT doc_id, doc_id % 6 IN (0, 3, 5) AS target FROM documents")
def console_targets(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d, _CONSOLE).select("doc_id", entries.console_target(F.col("file")).alias("target"))


@query("SELECT doc_id, CAST(doc_id % 4 AS BIGINT) AS n FROM documents WHERE doc_id % 4 > 0")
def console_logs(spark: SparkSession, d: str) -> DataFrame:
    text = _cat("let a = 1;\n", F.repeat(F.lit("  console.log('x', a);\n"), (F.col("doc_id") % 4).cast("int")), "foo(console.log);\nconsole.log(\n")
    return entries.console_logs(table(spark, d, "documents").select(_p(), _text("doc_id").alias("file"), text.alias("content"))).select(as_long("file").alias("doc_id"), as_long("n"))


@query("SELECT doc_id, 'framework:' || CASE source WHEN 'src0' THEN 'next' WHEN 'src1' THEN 'nuxt' END AS reason FROM documents WHERE (source = 'src0' AND doc_id % 2 = 0) OR (source = 'src1' AND doc_id % 2 = 1)")
def framework_entries(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("source").alias("project"), _cat(F.when(F.col("doc_id") % 2 == 0, "pages/").otherwise("views/"), "f", _text("doc_id"), ".js").alias("file"))
    detected = spark.createDataFrame([("src0", "next"), ("src1", "nuxt")], "project string, framework string")
    rules = spark.createDataFrame([("next", "^pages/"), ("nuxt", "^views/"), ("gatsby", "^")], "framework string, pattern string")
    return entries.by_framework(files, detected, rules).select(_number("file", r"f(\d+)\.js$").alias("doc_id"), "reason")


@query("SELECT p_partkey AS id, p_partkey % 4 IN (0, 1) AS injected FROM part")
def injected_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    notes = F.when(k == 0, F.array(F.lit("Controller"))).when(k == 3, F.array(F.lit("Plain"))).otherwise(F.array(F.lit("Injectable")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), entries.injected(notes, F.array(F.when(k == 1, "root").otherwise("nowhere"))).alias("injected"))


@query("SELECT p_partkey AS file FROM part WHERE p_size <= 25")
def configured_entries(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(_p(), _cat("packages/a/src/f", _text("p_partkey"), ".ts").alias("file"))
    named = table(spark, d, "part").filter("p_size <= 25").select(_p(), F.when(F.col("p_size") % 2 == 0, _cat("./src/f", _text("p_partkey"), ".ts")).otherwise(_cat("a/src/f", _text("p_partkey"))).alias("entry"))
    return entries.configured(files, named).select(_number("file", r"f(\d+)\.ts$").alias("file"))


@query(f"WITH {_CUSTOMERS_SQL} SELECT customer FROM c WHERE r IN (1, 3)")
def autoloaded_files(spark: SparkSession, d: str) -> DataFrame:
    places = spark.createDataFrame([("p", "r1"), ("p", "r3")], "project string, directory string")
    return entries.autoloaded(_customer_files(spark, d), places).select(_number("file", r"c(\d+)\.js$").alias("customer"))


@query("SELECT p_partkey AS file, CASE p_partkey % 6 WHEN 0 THEN 'main-block' WHEN 1 THEN 'main' WHEN 2 THEN 'annotation' WHEN 3 THEN 'init' WHEN 4 THEN 'main' END AS reason FROM part WHERE p_partkey % 6 < 5")
def metadata_entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    pick = lambda *v: F.when(k == 0, v[0]).when(k == 1, v[1]).when(k == 2, v[2]).when(k == 3, v[3]).when(k == 4, v[4]).otherwise(v[5])
    lang = pick("python", "java", "java", "go", "rust", "go")
    text = pick("def a():\n    pass\n\nif __name__ == '__main__':\n    a()\n", "class A {\n  static void main(String[] a) {\n  }\n  public static void main(String[] a) {\n  }\n}\n", "@RestController\npublic class A {\n}\n", "package a\n\nfunc init() {\n}\n", "fn main() {\n}\n", "package a\n\nfunc help() {\n}\n")
    files = table(spark, d, "part").select(_p(), _text("p_partkey").alias("file"), lang.alias("lang"), text.alias("content"))
    found = entries.by_metadata(entries.metadata(files, parse.parsed(files)))
    return found.select(as_long("file"), "reason")


@query("SELECT p_partkey AS file, CASE WHEN p_partkey % 3 = 0 THEN 'c' WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a' END AS reason FROM part")
def best_reason(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(_p(), F.col("p_partkey").alias("file"))
    found = part.withColumns({"reason": F.lit("a"), "confidence": F.lit(0.5)})
    found = found.unionByName(part.filter("file % 2 = 0").withColumns({"reason": F.lit("b"), "confidence": F.lit(0.7)})).unionByName(part.filter("file % 3 = 0").withColumns({"reason": F.lit("c"), "confidence": F.lit(0.9)}))
    return entries.best(found).select("file", "reason")


@query("SELECT source AS project, count(*) AS files, count(*) FILTER (lang = 'en') AS dead, round(100.0 * count(*) FILTER (lang = 'en') / count(*), 2) AS dead_rate FROM documents GROUP BY ROLLUP (source)")
def by_repository(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("project"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("dead"))
    return entries.by_repository(rows)


@query("SELECT p_partkey AS id FROM part WHERE p_size >= 5 AND p_partkey % 5 NOT IN (0, 1)")
def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "beforeEach").when(k == 1, _cat("useX", _text("p_partkey"))).otherwise(_cat("fn", _text("p_partkey")))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), (F.col("p_size") * 10).alias("size"), F.lit(9).alias("line_count"))
    return duplicates.candidates(rows).select("id")


# --- git, submodules, caches, logs, bundles ----------------------------------------------------------------------


@query("SELECT o_orderpriority AS author, 'p' || l_partkey || '.js' AS file, count(*) AS commits, min(o_orderdate) AS first_commit FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def git_commits(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", _text(F.col("o_custkey") % 8).alias("source"))
    heads = orders.select("source", (F.col("o_orderkey") * 100).alias("n"), F.concat(F.lpad(F.hex("o_orderkey"), 8, "0"), F.lit("|"), "o_orderpriority", F.lit("|"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("value"))
    lines = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select("source", (F.col("o_orderkey") * 100 + 1 + F.col("l_linenumber")).alias("n"), F.concat(F.lit("3\t1\t"), F.when(F.col("l_partkey") % 2 == 0, _cat("{old => }/p", _text("l_partkey"), ".js")).otherwise(_cat("p", _text("l_partkey"), ".js"))).alias("value"))
    heads = heads.select("source", "n", F.concat(F.lower(F.substring("value", 1, 8)), F.substring("value", 9, 200)).alias("value"))
    found = sources.git_log(heads.unionByName(rows))
    return found.groupBy("author", F.regexp_replace("file", "^/", "").alias("file")).agg(F.count(F.lit(1)).alias("commits"), F.min("ts").cast(dict(table(spark, d, "orders").dtypes)["o_orderdate"]).alias("first_commit"))


@query("SELECT c_custkey AS customer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT LIKE 'A%'")
def submodule_files(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    lines = region.filter("r_name LIKE 'A%'").select(_cat("\tpath = ", F.col("r_name")).alias("value")).unionByName(region.select(F.lit("[submodule]").alias("value")))
    nations = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    files = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), _text("c_custkey")).alias("file"))
    return sources.outside_submodules(files, sources.submodule_paths(lines)).select(F.substring_index("file", "/", -1).cast("long").alias("customer"))


@query("SELECT 'again' AS what, count(*) AS files FROM documents WHERE coalesce(lang, '') <> 'en' UNION ALL SELECT 'held', count(*) FROM documents WHERE lang = 'en'")
def unchanged_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(_text("doc_id").alias("file"), F.concat(F.lit("x"), F.coalesce("text", F.lit(""))).alias("content"), "lang")
    before = files.withColumn("hash", F.when(F.col("lang") == "en", F.sha2("content", 256)).otherwise("other")).select("file", "hash")
    again, held = sources.unchanged(files, before)
    count = lambda rows, what: rows.agg(F.count(F.lit(1)).alias("files")).select(F.lit(what).alias("what"), "files")
    return count(again, "again").unionByName(count(held, "held"))


@query("SELECT source AS project, CAST(sum(n_chars) FILTER (doc_id % 3 = 0) AS BIGINT) AS js, CAST(sum(n_chars) FILTER (doc_id % 3 = 1) AS BIGINT) AS css, CAST(sum(n_chars) FILTER (doc_id % 3 = 2) AS BIGINT) AS html, CAST(sum(n_chars) AS BIGINT) AS total FROM documents GROUP BY 1")
def bundle_sizes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    docs = table(spark, d, "documents")
    own = docs.select(F.col("source").alias("project"), _cat("dist/f", _text("doc_id"), F.when(k == 0, ".js").when(k == 1, ".css").otherwise(".html")).alias("file"), F.col("n_chars").alias("size"))
    maps = docs.select(F.col("source").alias("project"), _cat("dist/f", _text("doc_id"), ".js.map").alias("file"), F.col("n_chars").alias("size"))
    later = docs.select(F.col("source").alias("project"), _cat("out/f", _text("doc_id"), ".js").alias("file"), F.col("n_chars").alias("size"))
    return assets.bundles(own.unionByName(maps).unionByName(later)).select("project", "js", "css", "html", "total")


_LOGS_SQL = "l AS (SELECT 'd' || (p_partkey % 40) AS directory, p_size * (p_partkey % 40) * 100000 AS size FROM part WHERE p_partkey % 2 = 0)"


def _logs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return assets.logs(table(spark, d, "part").select(_p(), _cat("d", _text(k % 40), "/f", _text(k), F.when(k % 2 == 0, ".log").otherwise(".txt")).alias("file"), (F.col("p_size") * (k % 40) * 100_000).cast("long").alias("size")))


@query(f"WITH {_LOGS_SQL} SELECT directory, count(*) AS files, CAST(sum(size) AS BIGINT) AS total, CASE WHEN max(size) > 104857600 THEN 'critical' WHEN max(size) > 10485760 THEN 'warning' ELSE 'ok' END AS level FROM l GROUP BY 1")
def log_directories(spark: SparkSession, d: str) -> DataFrame:
    return _logs(spark, d).select("directory", "files", "total", "level")


@query(f"WITH {_LOGS_SQL} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total FROM l HAVING sum(size) > 52428800")
def too_many_logs(spark: SparkSession, d: str) -> DataFrame:
    return assets.too_many_logs(_logs(spark, d)).select("files", "total")


@query(f"WITH {_ASSET_SQL} SELECT path, CASE p_partkey % 5 WHEN 2 THEN 'font' WHEN 3 THEN 'svg' WHEN 4 THEN 'video' ELSE 'image' END AS kind FROM a")
def asset_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _asset_rows(spark, d).select("path", assets.kind(F.col("path")).alias("kind"))


@query("SELECT p_partkey AS id, 'img/p' || p_partkey || '.png' AS name FROM part UNION SELECT p_partkey, 'p' || p_partkey || '.png' FROM part")
def asset_references(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(_p(), _text("p_partkey").alias("file"), _cat("<img src='./img/p", _text("p_partkey"), ".png?v=2'> plain.png").alias("content"))
    return assets.references(files).select(_number("name", r"p(\d+)\.png$").alias("id"), "name")


@query("SELECT p_partkey AS id, CAST(p_size * 2 AS INTEGER) AS width, CAST(p_partkey % 900 + 1 AS INTEGER) AS height, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'gif' ELSE 'jpeg' END AS format FROM part")
def image_dimensions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    wide, high = F.col("p_size") * 2, k % 900 + 1
    big = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))
    small = lambda c: F.concat(F.unhex(F.lpad(F.hex((c % 256).cast("long")), 2, "0")), F.unhex(F.lpad(F.hex(F.floor(c / 256).cast("long")), 2, "0")))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), big(wide, 4), big(high, 4))
    gif = F.concat(F.unhex(F.lit("474946383961")), small(wide), small(high))
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE00004FFC0FFE10006FFC2AABBFFC2000B08")), big(high, 2), big(wide, 2))
    content = F.when(k % 3 == 0, png).when(k % 3 == 1, gif).otherwise(jpeg)
    return table(spark, d, "part").select(k.alias("id"), assets.dimensions(content).alias("x")).select("id", "x.width", "x.height", "x.format")
