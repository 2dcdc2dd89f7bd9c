import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import dependencies, duplicates, entries, graph, history, issues, names, patterns
from quarry.sinks import reports
from quarry.sources import code, configs, files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def col(rows, name):
    return sorted(r[name] for r in rows.collect())


SOURCES = [
    ("js", "src/index.js", "import { used } from './used.js'\nused()\n"),
    ("js", "src/used.js", "import x from './lib'\nexport function used() { return helper() }\nfunction helper() { return 1 }\nexport function neverImported() {}\n"),
    ("js", "src/lib/index.js", "export default 1\n"),
    ("js", "src/orphan.js", "export const y = 1\n"),
    ("py", "main.py", "from app.worker import run\nrun()\n"),
    ("py", "app/worker.py", "import os\nclass W:\n    def _live(self):\n        return 1\ndef run():\n    return W()._live()\n"),
]


@pytest.fixture()
def tree(spark):
    rows = spark.createDataFrame(SOURCES, "project string, file string, content string")
    return rows.withColumn("lang", files.language(F.col("file"))).withColumn("size", F.length("content"))


def test_dead_files_end_to_end(spark, tree):
    edges = code.resolved(code.imports(tree), tree)
    assert {(r.src, r.dst) for r in edges.collect()} == {("src/index.js", "src/used.js"), ("src/used.js", "src/lib/index.js"), ("main.py", "app/worker.py")}
    seeds = tree.filter(code.entry_reason(F.col("file")).isNotNull()).select("project", F.col("file").alias("node"))
    nodes = tree.select("project", F.col("file").alias("node"))
    for method in ("search", "rounds"):
        reached = graph.reachable(edges, seeds, method=method)
        assert col(graph.not_reached(nodes, reached, seeds), "node") == ["src/orphan.js"]


def test_reachability_of_both_methods_agrees_on_a_cycle(spark):
    edges = spark.createDataFrame([("p", a, b) for a, b in ("ab", "bc", "ca", "cd", "xy")], "project string, src string, dst string")
    seeds = spark.createDataFrame([("p", "a")], "project string, node string")
    want = [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    for method in ("search", "rounds"):
        assert sorted((r.node, r.depth) for r in graph.reachable(edges, seeds, method=method).collect()) == want
    assert graph.reachable(edges, seeds.limit(0)).count() == 0


def test_usage_through_barrels(spark):
    usage = spark.createDataFrame([("p", "index", "a"), ("p", "index", "b")], "project string, target string, symbol string")
    reexports = spark.createDataFrame([("p", "index", "one", "a"), ("p", "index", "two", "*"), ("p", "two", "three", "*")], "project string, barrel string, source string, name string")
    want = {("index", "a"), ("index", "b"), ("one", "a"), ("two", "b"), ("three", "b")}
    for passes in (None, 5):
        assert {(r.target, r.symbol) for r in graph.propagate_usage(usage, reexports, passes).collect()} == want


def test_partly_dead_needs_live_and_dead(spark):
    exports = spark.createDataFrame([("p", "m", "a", False), ("p", "m", "b", False), ("p", "n", "c", True), ("p", "w", "d", False)], "project string, file string, name string, is_default boolean")
    usage = spark.createDataFrame([("p", "m", "a", "i"), ("p", "n", "default", "i"), ("p", "w", "__ALL__", "i")], "project string, target string, symbol string, importer string")
    got = graph.partly_dead(exports, usage).collect()
    assert [(r.file, r.live, r.dead, r.dead_names) for r in got] == [("m", 1, 1, ["b"])]


def test_names_elsewhere_and_unreferenced(spark, tree):
    tokens = names.index(tree)
    wanted = spark.createDataFrame([("js", "src/used.js", n) for n in ("used", "helper", "neverImported")], "project string, file string, name string")
    assert col(names.named_elsewhere(wanted, tokens), "name") == ["used"]
    assert col(names.unreferenced(wanted, tokens), "name") == ["neverImported"]


def test_pattern_scan_takes_the_first_rule_and_boosts(spark):
    rows = [("p", "src/auth/a.js", "js", "eval(x)\nconst s = `\neval(y)\n`\n<Code lang='js'>\neval(z)\n// eval(c)"), ("p", "b.py", "py", "pickle.load(f)\ninnerHTML = 1")]
    found = patterns.scan(spark.createDataFrame(rows, "project string, file string, lang string, content string")).collect()
    assert sorted((r.file, r.line, r.rule, r.severity) for r in found) == [("b.py", 1, "CWE-502-pickle", "HIGH"), ("src/auth/a.js", 1, "CWE-94-eval", "CRITICAL")]


@pytest.mark.parametrize(
    ("severity", "boost", "want"), [("LOW", "MEDIUM", "MEDIUM"), ("HIGH", "MEDIUM", "HIGH"), ("HIGH", "CRITICAL", "CRITICAL"), ("CRITICAL", "CRITICAL", "CRITICAL"), ("LOW", None, "LOW")]
)
def test_boost(spark, severity, boost, want):
    assert one(spark, patterns.boosted(F.lit(severity), F.lit(boost).cast("string"))) == want


def test_near_pairs_against_brute_force(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta iota", "one two three four", "alpha beta gamma delta epsilon zeta eta theta"]
    rows = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "id long, scope string, code string")
    got = {(r.id_a, r.id_b) for r in duplicates.near_pairs(rows, 0.8).collect()}
    assert got == {(0, 1)}


def test_near_members_names_every_copy(spark):
    near = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta iota"]
    rows = [(0, "x", near[0]), (1, "x", near[1]), (2, "x", "one two three four"), (3, "x", near[0]), (4, "x", "one two three four"), (5, None, near[0]), (6, None, near[1]), (7, None, near[1]), (8, "x", None), (9, "x", None)]
    frame = spark.createDataFrame(rows, "id long, scope string, code string")
    assert {(r.id_a, r.id_b) for r in duplicates.near_pairs(frame, 0.8).collect()} == {(0, 1), (5, 6)}
    got = {r.id: (r.representative, r.copies, r.links) for r in duplicates.near_members(frame, 0.8).collect()}
    assert got == {0: (0, 2, 1), 3: (0, 2, 1), 1: (1, 1, 1), 2: (2, 2, 0), 4: (2, 2, 0), 5: (5, 1, 1), 6: (6, 2, 1), 7: (6, 2, 1), 8: (8, 1, 0), 9: (9, 1, 0)}


def _shuffled(spark):
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_near_pairs_move_texts_by_neighbourhood(spark):
    import random

    rng = random.Random(5)
    words = [f"w{rng.getrandbits(60):x}" for _ in range(400)]
    texts = [" ".join(w if rng.random() > 0.02 else f"x{rng.getrandbits(60):x}" for w in words) for _ in range(120)]
    rows = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "id long, scope string, code string")
    before = _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r.id_a, r.id_b): r.similarity for r in duplicates.near_pairs(rows, 0.8).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = _shuffled(spark) - before
    sets = [set(t.split()) for t in texts]
    want = {}
    for a in range(120):
        for b in range(a + 1, 120):
            common = len(sets[a] & sets[b])
            s = 0.7 * common / (len(sets[a]) + len(sets[b]) - common) + 0.3 * min(len(texts[a]), len(texts[b])) / max(len(texts[a]), len(texts[b]))
            if round(s, 6) >= 0.8:
                want[a, b] = s
    assert len(want) > 6000 and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)
    assert moved < 5 * sum(map(len, texts))


def _near_groups(groups, copies, words, changed, seed):
    import random

    rng = random.Random(seed)
    word = lambda: f"w{rng.getrandbits(60):x}"
    texts = []
    for _ in range(groups):
        own = [word() for _ in range(words)]
        texts += [" ".join(w if rng.random() > changed else word() for w in own) for _ in range(copies)]
    return list(enumerate(texts))


def _near_by_hand(texts, least):
    sets, want = [set(t.split()) for _, t in texts], {}
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            common, lengths = len(sets[a] & sets[b]), sorted((len(texts[a][1]), len(texts[b][1])))
            s = round(0.7 * common / (len(sets[a]) + len(sets[b]) - common) + 0.3 * lengths[0] / lengths[1], 6)
            if s >= least:
                want[a, b] = s
    return want


def test_near_pairs_in_rounds_are_those_of_one_round(spark, monkeypatch):
    texts = _near_groups(6, 30, 60, 0.07, 7)
    rows = spark.createDataFrame([(i, "x", t) for i, t in texts], "id long, scope string, code string")
    monkeypatch.setattr(duplicates, "LEAST_MEETINGS", 2000)
    monkeypatch.setattr(duplicates, "MEETINGS_A_ROW", 1)
    monkeypatch.setattr(duplicates, "TOKENS", 1)
    rounds, counted = [], duplicates._rounds
    monkeypatch.setattr(duplicates, "_rounds", lambda *a: rounds.append(counted(*a)) or rounds[-1])
    got = {(r.id_a, r.id_b): r.similarity for r in duplicates.near_pairs(rows, 0.85).collect()}
    want = _near_by_hand(texts, 0.85)
    assert rounds[0] > 1 and len(want) > 1000 and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-6 for p in want)


def test_near_members_count_links_of_all_rounds(spark, monkeypatch):
    texts = _near_groups(2, 20, 200, 0.03, 11)
    rows = spark.createDataFrame([(i, "x", t) for i, t in texts] + [(99, "x", texts[0][1])], "id long, scope string, code string")
    monkeypatch.setattr(duplicates, "_rounds", lambda *a: 2)
    got = {r.id: (r.representative, r.copies, r.links) for r in duplicates.near_members(rows, 0.85).collect()}
    links = [i for pair in _near_by_hand(texts, 0.85) for i in pair]
    assert len(links) > 400 and got == {i: (i % 99, 2 if i % 99 == 0 else 1, links.count(i % 99)) for i in [*range(40), 99]}


def test_near_rows_meet_once_for_each_run_of_tokens(spark):
    texts = _near_groups(1, 60, 400, 0.01, 8)
    sets = duplicates._prefixes(spark.createDataFrame([(i, "x", t) for i, t in texts], "id long, scope string, code string"), 0.85).cache()
    each = duplicates._postings(sets)
    met = duplicates._met(each, each, 0.85)
    assert met.distinct().count() == 60 * 59 // 2 and met.count() < 6 * 60 * 59 // 2
    sets.unpersist()


def test_near_texts_move_once_for_their_group(spark):
    """Each is near to a tenth of its group, so that smallest neighbours differ."""
    import random

    rng = random.Random(9)
    pairs = [(a, b) for a in range(300) for b in range(a + 1, 300) if rng.random() < 0.1]
    cells = duplicates._cells(spark.createDataFrame(pairs, "id_a long, id_b long"))
    assert sorted((r.id_a, r.id_b) for r in cells.collect()) == pairs
    assert cells.select("cell", F.explode(F.array("id_a", "id_b")).alias("id")).distinct().count() < 320


def test_a_cell_compares_only_within_scopes():
    import pyarrow as pa

    texts = pa.table({"of": [1] * 4, "id": [1, 2, 3, 4], "scope": ["x", "y", None, None], "length": [5, 5, 5, 8], "words": ["ab cd", "ab cd", "ab cd", "ab cd ef"]})
    pairs = [(1, 2), (3, 4), (1, 3)]
    cell = lambda found: duplicates._compared(pa.table({"cell": [1] * len(found), "id_a": [a for a, _ in found], "id_b": [b for _, b in found]}), texts)
    assert [tuple(r.values()) for r in cell(pairs).to_pylist()] == [(3, 4, 2, 2, 3, 5, 8)]
    assert cell(pairs[:1]).num_rows == 0


def test_riskiest_vulnerabilities_order_brands_before_keys(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quarry import catalog
    from tests.parity import same

    keys = [12, 24, 36, 12_000_000_000, 1_200_000_000, 15, 48, 60, *range(72, 720, 12)]
    brands = ["Brand#1" if k in (15, 36) or k > 400 else "Brand#10" for k in keys]
    pq.write_table(pa.table({"p_partkey": keys, "p_brand": brands}), tmp_path / "part.parquet")
    same(spark, catalog.QUERIES["riskiest_vulnerabilities"], catalog.ORACLES["riskiest_vulnerabilities"], str(tmp_path))


def test_normalized_code(spark):
    assert one(spark, duplicates.normalized_code(F.lit("a = 1 // x\n/* y */ b('z')"))) == "a=0 b('')"


def test_versions_and_updates(spark):
    assert one(spark, S.version(F.lit("^1.2.x"))) == [1, 2, 0]
    assert one(spark, S.update_type(F.lit("1.9.0"), F.lit("2.0.0"))) == "major"
    assert one(spark, S.update_type(F.lit("1.2.3"), F.lit("1.2.3"))) == "patch"
    for tag, kind in (("2.0.0-rc.1", "prerelease"), ("v3.0.0", "stable"), ("1.4.0", "stable"), ("1.0.0-0", "prerelease"), ("v2.0.0beta", "prerelease")):
        assert one(spark, S.bump_type(F.lit(tag))) == kind
    assert one(spark, S.fixed_version(F.lit(">=4.18.0 <5"))) == "4.18.0" and one(spark, S.fixed_version(F.lit("<1"))) == "unknown"
    assert one(spark, S.days_behind(F.lit("2024-01-01 12:00:00").cast("timestamp"), F.lit("2024-02-01 00:00:00").cast("timestamp"))) == 30


@pytest.mark.parametrize(("name", "want"), [("MIT AND GPL-3.0", "permissive"), ("UNLICENSED", "permissive"), ("GPL-3.0", "copyleft"), ("SSPL-1.0", "restrictive"), (None, "unknown"), ("?", "unknown"),
    ("BSL-1.1", "restrictive"), ("Sleepycat", "restrictive"), ("CPL-1.0", "copyleft"), ("QPL-1.0", "copyleft"), ("X11", "permissive"), ("Zope-2.0", "permissive"), ("CC-BY-4.0", "permissive"),
    ("X11 OR Sleepycat", "restrictive"), ("(Fair AND CPL-1.0)", "copyleft"), ("Fair OR what", "permissive"), ("BUSL-1.1", "restrictive"), ("bsl-1.1", "unknown")])
def test_licence_classes(spark, name, want):
    assert one(spark, S.license_class(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(("name", "want"), [("LGPL-3.0", "high"), ("MPL-2.0", "medium"), ("Apache-2.0", "low"), ("MIT", "low"), ("EUPL-1.2", "medium"), ("Elastic-2.0", "medium"), ("my own", "unknown"), (None, "unknown"), ("QPL-1.0", "high")])
def test_licence_risk(spark, name, want):
    assert one(spark, S.license_risk(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(("dead", "total", "want"), [(2, 2, 0.0), (0, 9, 0.0), (3, 3, 7.0), (1, 4, 1.8), (None, None, 0.0)])
def test_dead_export_share(spark, dead, total, want):
    assert one(spark, S.dead_export_share(F.lit(dead).cast("int"), F.lit(total).cast("int"))) == want


@pytest.mark.parametrize(("days", "git", "want"), [(800.0, 0.0, 10.0), (800.0, 1.2, 0.0), (365.0, 0.0, 5.0), (None, 0.0, 0.0), (100.0, 0.0, 0.0)])
def test_mtime_staleness(spark, days, git, want):
    assert one(spark, S.mtime_staleness(F.lit(days).cast("double"), F.lit(git))) == want


@pytest.mark.parametrize(("c30", "c90", "c365", "want"), [(0, 0, 2, 0.0), (0, 9, 12, 25.0), (3, 9, 12, 0.0), (2, 12, 12, 7.5), (1, 12, 12, 21.3)])
def test_velocity(spark, c30, c90, c365, want):
    assert one(spark, S.velocity_decline(F.lit(c30), F.lit(c90), F.lit(c365))) == want


@pytest.mark.parametrize(("days", "want"), [(0.0, 0.0), (180.0, 0.0), (365.0, 6.5), (730.0, 11.0), (731.0, 13.0)])
def test_staleness(spark, days, want):
    assert one(spark, S.staleness(F.lit(days))) == want


def test_paths(spark):
    assert one(spark, S.joined(F.lit("src/a"), F.lit("../b/./c.js"))) == "src/b/c.js"
    assert one(spark, S.renamed_path(F.lit("src/{old => new}/x.js"))) == "src/new/x.js"
    assert one(spark, S.ancestors(F.lit("a/b/c.js"))) == ["a", "a/b"]
    assert one(spark, S.dirname(F.lit("c.js"))) == "."


def test_formats(spark):
    assert one(spark, S.format_bytes(F.lit(1536))) == "1.5 KB"
    assert one(spark, S.format_currency(F.lit(12345.0))) == "£12.3k"
    assert one(spark, S.interval_ms(F.lit("30m"))) == 1_800_000
    assert one(spark, S.interval_ms(F.lit("soon"))) == 21_600_000


def test_diff_has_every_issue_once(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, size long")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "id string, size long")
    assert {(r.id, r.status) for r in history.scan_diff(a, b, "id").collect()} == {("x", "resolved"), ("y", "open"), ("z", "new")}


def test_periods(spark):
    start, end = history.period("last-quarter", F.lit("2024-05-10 00:00:00").cast("timestamp"))
    assert str(one(spark, start)) == "2024-01-01 00:00:00" and str(one(spark, end)) == "2024-04-01 00:00:00"


def test_thresholds_skip_what_has_no_limit(spark):
    got = issues.thresholds(spark.createDataFrame([(1.0, 5.0)], "a double, b double"), {"a": 1, "b": None}).collect()
    assert [(r.check, r.passed) for r in got] == [("a", True)]


def test_advisories_only_below_the_fix(spark):
    packages = spark.createDataFrame([("p", "x", "1.0.0"), ("p", "y", "2.0.0")], "project string, name string, version string")
    known = spark.createDataFrame([("x", "C1", "critical", "1.1.0", "f"), ("y", "C2", "high", "2.0.0", "g")], "name string, cve string, severity string, fixed_in string, function string")
    usage = spark.createDataFrame([("p", "x", "f")], "project string, name string, function string")
    assert [(r.cve, r.risk, r.priority) for r in dependencies.advisories(packages, known, usage).collect()] == [("C1", "high", "critical")]


def test_breaking_changes(spark):
    text = ["# 2.0", "## Breaking changes", "- gone", "* moved", "## Fixes", "- small"]
    rows = spark.createDataFrame([("v", i, t) for i, t in enumerate(text)], "release string, line long, line_text string")
    assert col(dependencies.breaking_changes(rows, "release"), "change") == ["gone", "moved"]


def test_discovery_and_language(spark, tmp_path):
    for name in ("src/a.ts", "node_modules/x/i.js", "b.min.js", "c.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    got = files.discover(spark, f"file://{tmp_path}", "p")
    assert {(r.file, r.lang) for r in got.collect()} == {("src/a.ts", "javascript"), ("c.py", "python")}


def test_longest_scope(spark):
    rows = spark.createDataFrame([("p", "packages/a/src/x.js"), ("p", "y.js")], "project string, file string")
    scopes = spark.createDataFrame([("p", "packages"), ("p", "packages/a")], "project string, directory string")
    assert {(r.file, r.scope) for r in files.longest_scope(rows, scopes).collect()} == {("packages/a/src/x.js", "packages/a"), ("y.js", None)}


def test_git_log(spark):
    text = ["abcdef1|ann|2024-01-02T03:04:05Z", "1\t2\tsrc/{a => b}/f.js", "-\t-\timg.png", "abcdef2|bob|2024-01-03T00:00:00Z", "1\t0\tg.js"]
    rows = spark.createDataFrame([("log", i, t) for i, t in enumerate(text)], "source string, n long, value string")
    assert {(r.file, r.author) for r in files.git_log(rows).collect()} == {("src/b/f.js", "ann"), ("img.png", "ann"), ("g.js", "bob")}


def test_configs(spark):
    rows = [
        ("p", "package.json", '{"dependencies": {"a": "^1.0.0"}, "devDependencies": {"b": "2"}, "scripts": {"go": "node scripts/x.js"}}'),
        ("p", ".github/workflows/ci.yml", "run: node tools/ci.mjs"),
        ("p", "Cargo.toml", ""),
    ]
    tree = spark.createDataFrame(rows, "project string, file string, content string")
    assert {(r.name, r.declared_in) for r in configs.manifests(tree).collect()} == {("a", "dependencies"), ("b", "devDependencies")}
    assert {(r.reader, r.path) for r in configs.entries(tree).collect()} == {("scripts", "scripts/x.js"), ("actions", "tools/ci.mjs")}
    assert col(configs.build_systems(tree), "system") == ["cargo"]


def test_sarif_and_store(spark, tmp_path):
    found = spark.createDataFrame([("r", "high", "a.js", 3, "m")], "rule string, severity string, file string, line int, message string")
    assert '"level":"error"' in reports.sarif(found, "quarry").first()["sarif"]
    path = str(tmp_path / "store")
    reports.upsert(spark, path, spark.createDataFrame([("k", 1, "old")], "key string, at int, v string"), ["key"], "at")
    got = reports.upsert(spark, path, spark.createDataFrame([("k", 2, "new")], "key string, at int, v string"), ["key"], "at")
    assert [r.v for r in got.collect()] == ["new"]


def test_rescan_hands_over_new_files(spark, tmp_path):
    from quarry.streaming import monitor

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a")], "id long, v string").write.parquet(source)
    seen = []
    for _ in range(2):
        monitor.rescan(spark, source, "id long, v string", str(tmp_path / "cp"), lambda df, _: seen.append(df.count())).awaitTermination()
    assert seen == [1]


def test_entry_rules(spark):
    assert [bool(entries.re_match(g, p)) for g, p in (("src/**/*.ts", "src/a/b.ts"), ("src/*.ts", "src/a/b.ts"), ("*.{js,ts}", "x.ts"), ("**/x", "a/b/x"))] == [True, False, True, True]
    rows = spark.createDataFrame([("p", "src/a.ts", ["Injectable"], ["root"]), ("p", "src/b.ts", ["Other"], [])], "project string, file string, decorators array<string>, provided array<string>")
    assert col(rows.filter(entries.injected(F.col("decorators"), F.col("provided"))), "file") == ["src/a.ts"]
    named = spark.createDataFrame([("p", "a.ts"), ("p", "src/b")], "project string, entry string")
    assert col(entries.configured(rows, named), "file") == ["src/a.ts", "src/b.ts"]
    found = spark.createDataFrame([("p", "a", "test", 0.5), ("p", "a", "main", 0.9)], "project string, file string, reason string, confidence double")
    assert [(r.file, r.reason) for r in entries.best(found).collect()] == [("a", "main")]


def test_private_section_and_console_logs(spark):
    text = ["class A", "  def a", "  private", "  def b", "  public", "  def c"]
    rows = spark.createDataFrame([("p", "a.rb", i, t) for i, t in enumerate(text)], "project string, file string, line long, line_text string")
    assert col(entries.ruby_private(rows), "name") == ["b"]
    tree = spark.createDataFrame([("p", "a.js", "console.log(1)\n// console.log(2)\nx\nconsole.debug(3)")], "project string, file string, content string")
    assert entries.console_logs(tree).first()["n"] == 2


def test_login_is_close_to_authentication(spark):
    assert one(spark, patterns.highest_boost(F.lit("/src/Login/form.js"))) == "CRITICAL"
    assert len(patterns.PROXIMITY) == 23


def test_lines_inside_templates_and_after_markup_are_left_out(spark):
    text = "eval(a)\n// eval(b)\nx = `\neval(c)\n`; eval(d)\ny = \\`\neval(e)\n<div class='x'>\neval(f)\nz = `open\neval(g)\neval(h)"
    rows = spark.createDataFrame([("p", "a.js", "js", text)], "project string, file string, lang string, content string")
    assert sorted(r.line for r in patterns.scan(rows).collect()) == [1, 5, 7]


def test_settings_are_merged_by_key():
    from quarry.functions.settings import merged

    assert merged({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2], "e": None}}, None, {"d": {"f": 3}}) == {"a": {"b": 1, "c": [2]}, "d": {"f": 3}}


def test_sarif_levels(spark):
    rows = [("r", "critical", "a", 0, "m", "finding", None), ("r", "low", "a", 2, "m", "function", None), ("s", "high", "a", None, "m", "finding", "false-positive"), ("s", "low", "a", 2, "m", "export", "confirmed")]
    frame = spark.createDataFrame(rows, "rule string, severity string, file string, line int, message string, kind string, verdict string")
    assert [r.level for r in reports.sarif_results(frame).collect()] == ["error", "warning", "none", "error"]


def test_history_by_days_equals_the_log(spark, tmp_path):
    """Day by day, a day twice and a day in two parts: counts as over the log, authors within the sketch's bound; a new day reads its own commits alone."""
    rows = spark.range(60_000).selectExpr("'f' || id % 5 AS file", "'a' || (id * 7919) % 9000 AS author", "timestamp_seconds(1700000000 + (id * 7993) % (400 * 86400)) AS ts").withColumn("day", F.to_date("ts"))
    path = str(tmp_path / "days")
    last = rows.agg(F.max("day")).first()[0]
    history.keep_days(rows.filter(F.col("day") < F.lit(last)), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "days").rglob("*.parquet")}
    history.keep_days(rows.filter(F.col("day") == F.lit(last)), path)
    history.keep_days(rows.filter(F.col("day") == F.lit(last)), path)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    kept = history.kept_days(spark, path)
    as_of = F.timestamp_micros(F.unix_micros(F.lit(last).cast("timestamp")) + 86400_000_000 - 1)
    want = {r.file: r for r in history.commit_buckets(rows, as_of).collect()}
    parts = history.day_partials(rows.filter("hash(author) % 2 = 0")).unionByName(history.day_partials(rows.filter("hash(author) % 2 <> 0")))
    for partials in (kept, parts):
        got = {r.file: r for r in history.buckets_of_days(partials, F.lit(last)).collect()}
        assert got.keys() == want.keys()
        for f, r in got.items():
            assert [r[c] for c in r.asDict() if not c.startswith("contributors")] == [want[f][c] for c in r.asDict() if not c.startswith("contributors")]
            assert all(abs(r[c] - want[f][c]) <= 4 * 0.0082 * want[f][c] for c in ("contributors_all", "contributors_90d"))
    plan = history.buckets_of_days(kept, F.lit(last))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
