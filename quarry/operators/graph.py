"""Dependency graphs as edge tables (project, src, dst): reachability, usage, dead files and exports.

A repository's graph fits one task and many repositories spread out, so reachability is a grouped
search by project. A project with more edges than a task should hold is searched over tables instead:
leaves and chains are taken out by doubling, and only what is left goes through frontier rounds, in
which only nodes that were just reached are joined to the edges.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.shared import written
from quarry.shipping import ship

TASK_EDGES = 2_000_000
NODE = "project string, node string, depth long"


def _written(df: DataFrame) -> DataFrame:
    return written(df, "rounds")


def _renewed(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows under columns of their own, so that both sides of a cogroup may come from one table."""
    return df.select(*(F.col(c).alias(c) for c in columns)).distinct()


def _frame(**columns) -> pd.DataFrame:
    """Texts as plain objects, so that an empty frame has the types of a full one."""
    return pd.DataFrame({k: v if isinstance(v, pd.Series) else pd.Series(v, dtype=object) for k, v in columns.items()})


def _search(key, edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    after = edges.groupby("src")["dst"].agg(list).to_dict() if len(edges) else {}
    depth = dict.fromkeys(seeds["node"], 0)
    queue = deque(depth)
    while queue:
        node = queue.popleft()
        for nxt in after.get(node, ()):
            if nxt not in depth:
                depth[nxt] = depth[node] + 1
                queue.append(nxt)
    return _frame(project=[key[0]] * len(depth), node=list(depth), depth=pd.Series(list(depth.values()), dtype="int64"))


def _least(edges: DataFrame) -> DataFrame:
    """Each edge once, with its least length."""
    return edges.groupBy("project", "src", "dst").agg(F.min("length").alias("length"))


def _frontier(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """project, node, depth: rounds in which nodes whose depth fell in the last one hand on their edges' lengths."""
    found = frontier = _written(seeds.select("project", "node", F.lit(0).cast("long").alias("depth")).distinct())
    done = 0
    while not frontier.isEmpty():
        done += 1
        step = frontier.select("project", F.col("node").alias("src"), "depth").join(edges, ["project", "src"])
        step = step.groupBy("project", F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        known = found.groupBy("project", "node").agg(F.min("depth").alias("_known"))
        step = step.join(known, ["project", "node"], "left").filter(F.col("_known").isNull() | (F.col("depth") < F.col("_known")))
        frontier = _written(step.select("project", "node", "depth"))
        found = found.unionByName(frontier)
        if done % 8 == 0:
            found = _written(found)
    return found.groupBy("project", "node").agg(F.min("depth").alias("depth"))


def _chained(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains taken out: the edges that stay, and (project, node, head, length) of each inner node of a chain.

    An inner node has one edge in and one out and is no seed, so it is reached through its chain's head alone.
    Heads are found by doubling: each node points two times as far after each round. A ring of inner nodes
    has no head and no seed, and is never reached; it is what still points at an inner node after as many
    doublings as the longest chain can need.
    """
    into = edges.groupBy("project", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.first("src").alias("head"), F.first("length").alias("length"))
    out = edges.groupBy("project", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    inner = into.filter("n_in = 1").join(out.filter("n_out = 1"), ["project", "node"]).filter("node <> head")
    inner = inner.join(seeds.select("project", "node"), ["project", "node"], "left_anti")
    open_ = _written(inner.select("project", "node", "head", "length"))
    marks = open_.select("project", F.col("node").alias("head"), F.lit(True).alias("_open"))
    rows = _written(open_.join(marks, ["project", "head"], "left").select("project", "node", "head", "length", F.col("_open").isNotNull().alias("open")))
    left, limit = rows.filter("open").count(), 1
    while left and limit <= left:
        far = rows.select("project", F.col("node").alias("head"), F.col("head").alias("_head"), F.col("length").alias("_length"), F.col("open").alias("_open"))
        jumped = rows.filter("open").join(far, ["project", "head"]).select("project", "node", F.col("_head").alias("head"), (F.col("length") + F.col("_length")).alias("length"), F.col("_open").alias("open"))
        rows = _written(rows.filter("NOT open").unionByName(jumped))
        now = rows.filter("open").count()
        # While any chain is open its nodes get fewer; only rings stay as they are.
        limit = limit * 2 if now == left else 1
        left = now
    heads = rows.filter("NOT open").select("project", "node", "head", "length")
    gone = rows.select("project", F.col("node").alias("dst"))
    kept = edges.join(gone, ["project", "dst"], "left_anti")
    ends = heads.select("project", F.col("node").alias("src"), F.col("head").alias("_head"), F.col("length").alias("_length"))
    kept = kept.join(ends, ["project", "src"], "left").join(rows.filter("open").select("project", F.col("node").alias("src")), ["project", "src"], "left_anti")
    joined = kept.select("project", F.coalesce("_head", "src").alias("src"), "dst", (F.col("length") + F.coalesce("_length", F.lit(0))).alias("length"))
    return _written(_least(joined)), heads


#: Times that leaves and chains are taken out, and the share of edges that has to go with one for another to follow.
CONTRACTIONS, WORTH = 6, 0.2


def _rounds(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """A search over tables whose rounds don't grow with the length of chains.

    Nodes without an edge out that are no seeds are set aside, then chains, and again what is now such:
    a tree or a chain is gone after rounds in the logarithm of its size. What is left is searched in
    rounds, one for each step; then what was set aside gets its depths, the last first.
    """
    seeds = _written(seeds.select("project", "node").distinct())
    edges = _written(_least(edges.filter("src <> dst").withColumn("length", F.lit(1).cast("long"))))
    taken, size = [], edges.count()
    for _ in range(CONTRACTIONS):
        sources = edges.select("project", F.col("src").alias("dst")).distinct()
        ends = edges.join(sources, ["project", "dst"], "left_anti").join(seeds.select("project", F.col("node").alias("dst")), ["project", "dst"], "left_anti")
        ends = _written(ends)
        inside = edges.join(ends.select("project", "dst").distinct(), ["project", "dst"], "left_anti")
        edges, heads = _chained(_written(inside), seeds)
        taken.append((ends, heads))
        now = edges.count()
        if not now or now > (1 - WORTH) * size:
            break
        size = now
    found = _frontier(edges, seeds)
    for ends, heads in reversed(taken):
        head = found.select("project", F.col("node").alias("head"), F.col("depth").alias("_depth"))
        found = found.unionByName(heads.join(head, ["project", "head"]).select("project", "node", (F.col("_depth") + F.col("length")).alias("depth")))
        found = _written(found)
        source = found.select("project", F.col("node").alias("src"), F.col("depth").alias("_depth"))
        last = ends.join(source, ["project", "src"]).groupBy("project", F.col("dst").alias("node")).agg(F.min(F.col("_depth") + F.col("length")).alias("depth"))
        found = _written(found.unionByName(last))
    return found


def reachable(edges: DataFrame, seeds: DataFrame, task_edges: int = TASK_EDGES, method: str = "auto") -> DataFrame:
    """project, node, depth: every node that a seed (project, node) leads to, with its least distance."""
    edges = edges.select("project", "src", "dst").distinct()
    if method != "search":
        # Written once: the edges may be long to make, and the count, the search or every round reads them.
        edges = _written(edges)
    if method == "auto":
        counts = edges.groupBy("project").count()
        method = "search" if counts.filter(F.col("count") > task_edges).isEmpty() else "rounds"
    if method == "rounds":
        return _rounds(edges, seeds)
    ship(edges.sparkSession)
    left = edges.groupBy("project")
    return left.cogroup(_renewed(seeds, "project", "node").groupBy("project")).applyInPandas(_search, NODE)


def not_reached(nodes: DataFrame, reached: DataFrame, *kept: DataFrame) -> DataFrame:
    """Nodes (project, node, ...) that are neither reached nor in any of ``kept``."""
    for other in (reached, *kept):
        nodes = nodes.join(other.select("project", "node"), ["project", "node"], "left_anti")
    return nodes


def importer_count(edges: DataFrame) -> DataFrame:
    """Import statements that lead to each file, not distinct importers."""
    return edges.groupBy("project", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("importer_count"))


def confidence(dynamic: F.Column, entries: F.Column) -> F.Column:
    return F.round(0.95 - F.when(dynamic, 0.2).otherwise(0.0) - F.when(entries < 5, 0.1).otherwise(0.0), 2)


def confidence_label(score: F.Column) -> F.Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "medium").otherwise("low")


#: Words in a path that tell of loading by name at run time.
DYNAMIC_WORDS = "plugin|middleware|handler|hook|extension|addon|adapter|driver|strategy|provider"


def verdict(path: F.Column) -> F.Column:
    return F.when(F.lower(path).rlike(DYNAMIC_WORDS), "possibly-live").otherwise("unreachable")


def shared_scope_edges(members: DataFrame) -> DataFrame:
    """Edges among files of one scope (project, scope, node) through a hub node: 2n edges for n files."""
    hub = F.concat(F.lit("scope:"), F.col("scope"))
    there = members.select("project", F.col("node").alias("src"), hub.alias("dst"))
    return there.unionByName(members.select("project", hub.alias("src"), F.col("node").alias("dst")))


def export_usage(reached: DataFrame, imports: DataFrame) -> DataFrame:
    """target, symbol, importer of imports in reached files only.

    ``imports``: project, file, target, type, specifiers. No specifiers: the module is used for its
    side effects, or as a whole where it was required or loaded; a namespace import uses ``*``.
    """
    live = imports.join(reached.select("project", F.col("node").alias("file")), ["project", "file"], "left_semi")
    none = F.size(F.coalesce("specifiers", F.array())) <= 0
    whole = F.array(F.when(F.col("type").isin("commonjs", "dynamic-import", "require"), "__ALL__").otherwise("__SIDE_EFFECT__"))
    named = F.transform("specifiers", lambda s: F.when(s["type"] == "namespace", "*").when(s["type"] == "default", "default").otherwise(s["name"]))
    return live.select("project", "target", F.explode(F.when(none, whole).otherwise(named)).alias("symbol"), F.col("file").alias("importer"))


def _spread(key, usage: pd.DataFrame, reexports: pd.DataFrame) -> pd.DataFrame:
    named: dict[str, list[tuple[str, str]]] = {}
    starred: dict[str, list[str]] = {}
    for barrel, source, name in zip(reexports["barrel"], reexports["source"], reexports["name"], strict=True):
        if name == "*":
            starred.setdefault(barrel, []).append(source)
        else:
            named.setdefault(barrel, []).append((name, source))
    seen = set(zip(usage["target"], usage["symbol"], strict=True))
    queue = deque(seen)
    while queue:
        target, symbol = queue.popleft()
        own = named.get(target, ())
        step = [(source, name) for name, source in own if symbol in ("*", "__ALL__", name)]
        if all(symbol != name for name, _ in own):
            step += [(source, symbol) for source in starred.get(target, ())]
        for at in step:
            if at not in seen:
                seen.add(at)
                queue.append(at)
    return _frame(project=[key[0]] * len(seen), target=[t for t, _ in seen], symbol=[s for _, s in seen])


def propagate_usage(usage: DataFrame, reexports: DataFrame, passes: int | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """Usage of a barrel's symbols reaches the files it re-exports them from, to a fixpoint or so many passes.

    ``usage``: project, target, symbol. ``reexports``: project, barrel, source, name, with ``*`` for
    all names but those the barrel itself names. As with reachability, a project is searched in one
    task unless it is too large, or passes are to be counted.
    """
    usage = usage.select("project", "target", "symbol").distinct()
    reexports = _written(reexports.select("project", "barrel", "source", "name").distinct())
    if passes is None and reexports.groupBy("project").count().filter(F.col("count") > task_edges).isEmpty():
        ship(usage.sparkSession)
        right = _renewed(reexports, "project", "barrel", "source", "name").groupBy("project")
        return usage.groupBy("project").cogroup(right).applyInPandas(_spread, "project string, target string, symbol string")
    usage = _written(usage)
    own = reexports.filter("name <> '*'").select("project", F.col("barrel").alias("target"), F.col("name").alias("symbol"))
    frontier, done = usage, 0
    while not frontier.isEmpty() and (passes is None or done < passes):
        done += 1
        by_name = reexports.filter("name <> '*'").select("project", F.col("barrel").alias("target"), "source", "name")
        named = frontier.join(by_name, ["project", "target"]).filter(F.col("symbol").isin("*", "__ALL__") | (F.col("symbol") == F.col("name")))
        named = named.select("project", F.col("source").alias("target"), F.col("name").alias("symbol"))
        stars = reexports.filter("name = '*'").select("project", F.col("barrel").alias("target"), "source")
        starred = frontier.join(own, ["project", "target", "symbol"], "left_anti").join(stars, ["project", "target"])
        step = named.unionByName(starred.select("project", F.col("source").alias("target"), "symbol")).distinct()
        frontier = _written(step.join(usage, ["project", "target", "symbol"], "left_anti"))
        usage = _written(usage.unionByName(frontier))
    return usage


def partly_dead(exports: DataFrame, usage: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Files with both live and dead exports: project, file, live, dead, dead_names.

    ``exports``: project, file, name, is_default. Files used as a whole, or only for their side
    effects, or by nobody, say nothing about single exports and are left out.
    """
    name = F.when(F.col("is_default"), "default").otherwise(F.col("name"))
    per = usage.groupBy("project", F.col("target").alias("file")).agg(
        F.max(F.col("symbol").isin("__ALL__", "*")).alias("whole"), F.max(~F.col("symbol").isin("__SIDE_EFFECT__")).alias("named")
    )
    used = usage.select("project", F.col("target").alias("file"), F.col("symbol").alias("_name"), F.lit(True).alias("_live")).distinct()
    rows = exports.withColumn("_name", name).join(per.filter("NOT whole AND named"), ["project", "file"]).join(used, ["project", "file", "_name"], "left")
    if excluded is not None:
        rows = rows.join(excluded.select("project", "file"), ["project", "file"], "left_anti")
    live = F.coalesce("_live", F.lit(False))
    per_file = rows.groupBy("project", "file").agg(
        F.count_if(live).alias("live"), F.count_if(~live).alias("dead"), F.array_sort(F.collect_set(F.when(~live, F.col("name")))).alias("dead_names")
    )
    return per_file.filter("live > 0 AND dead > 0")


#: Exports that frameworks call by name.
FRAMEWORK_EXPORTS = (
    "GET POST PUT DELETE PATCH HEAD OPTIONS middleware config metadata viewport revalidate dynamic dynamicParams fetchCache runtime preferredRegion maxDuration "
    "generateStaticParams generateMetadata generateViewport generateImageMetadata getServerSideProps getStaticProps getStaticPaths getInitialProps reportWebVitals "
    "loader action links handle meta shouldRevalidate ErrorBoundary HydrateFallback headers load prerender csr ssr trailingSlash entries actions onRequest"
).split()


def vetoed(partly: DataFrame, tokens: DataFrame) -> DataFrame:
    """``partly_dead`` rows without the dead names that occur in any other file, which may be used in ways imports do not show.

    ``tokens``: project, file, token of every file. ``default`` occurs everywhere and is never reported.
    """
    names = partly.select("project", "file", F.explode("dead_names").alias("name")).filter("name <> 'default'")
    other = tokens.select("project", F.col("file").alias("_other"), F.col("token").alias("name")).distinct()
    wanted = other.join(names.select("project", "name").distinct(), ["project", "name"], "left_semi")
    ends = wanted.groupBy("project", "name").agg(F.min("_other").alias("_low"), F.max("_other").alias("_high"))
    met = names.join(ends, ["project", "name"], "left")
    alone = met.filter(F.col("_low").isNull() | ((F.col("_low") == F.col("file")) & (F.col("_high") == F.col("file"))))
    left = alone.groupBy("project", "file").agg(F.array_sort(F.collect_set("name")).alias("dead_names"))
    return partly.drop("dead_names", "dead").join(left, ["project", "file"]).withColumn("dead", F.size("dead_names").cast("long"))


def by_dead_exports(partly: DataFrame) -> DataFrame:
    return partly.orderBy(F.desc("dead"), "project", "file")


def glob_seeds(files: DataFrame, globs: DataFrame) -> DataFrame:
    """Files (project, node) that a glob in any file's code (project, file, glob) takes in, whether that file is reached or not.

    Globs and files meet on the directory that the glob begins with, then by the glob's pattern.
    """
    from quarry.operators.entries import glob_column

    fixed = F.regexp_replace("glob", r"/?[^/]*[*?{\[].*$", "")
    folder = F.when(F.col("file").contains("/"), S.dirname(F.col("file"))).otherwise("")
    base = F.when(fixed.startswith("/"), F.substring(fixed, 2, 2147483647)).otherwise(S.joined(folder, fixed))
    tail = F.expr("substring(glob, length(_fixed) + 1)")
    own = globs.withColumn("_fixed", fixed).select("project", base.alias("_base"), F.regexp_replace(tail, "^/", "").alias("_tail")).distinct()
    above = files.select("project", "file", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.filter(S.ancestors(F.col("file")), lambda a: F.lit(True))))).alias("_base"))
    met = above.join(own, ["project", "_base"])
    rest = F.when(F.col("_base") == "", F.col("file")).otherwise(F.expr("substring(file, length(_base) + 2)"))
    return met.withColumn("_rest", rest).filter(F.rlike(F.col("_rest"), glob_column(F.col("_tail")))).select("project", F.col("file").alias("node")).distinct()


def used_packages(modules: DataFrame) -> DataFrame:
    """Package names (project, name) of import specifiers: two segments for scoped ones, else one."""
    m = F.col("module")
    outside = modules.filter(~m.rlike(r"^[./]") & ~m.startswith("node:"))
    name = F.when(m.startswith("@"), F.substring_index(m, "/", 2)).otherwise(F.substring_index(m, "/", 1))
    return outside.select("project", name.alias("name")).distinct()
