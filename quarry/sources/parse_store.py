"""What files parse to, kept by content; and a tree of hashes that tells which directories changed.

The store has one row for each content ever parsed: its hash and the rows that it gave, without the
file's name, which is put back when they are read. So a file parses once, whatever it is called and
however many copies there are; a change parses the changed files, a rename or a move none.

``directories`` gives every directory the hash of its children's names and hashes, level by level
from below, so two scans compare from the top: below equal hashes nothing is looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.shared import written
from quarry.sources import parse

#: Part of every hash: another number when readers change what they give.
READERS = "1"
_OF_FILE = ("project", "file", "lang")
_ROW = ", ".join(f for f in parse.SCHEMA.replace("struct<name:string,local_name:string,type:string>", "SPECIFIER").split(", ") if f.split()[0] not in _OF_FILE)
ROWS = "array<struct<" + ", ".join(f"{f.split()[0]}:{f.split(' ', 1)[1]}" for f in _ROW.split(", ")).replace("SPECIFIER", "struct<name:string,local_name:string,type:string>") + ">>"
STORED = f"hash string, rows {ROWS}"


def hashed(files: DataFrame) -> DataFrame:
    """``files`` with ``hash``: of the content and of what else decides how it is read."""
    component = F.col("file").rlike(r"\.(vue|svelte)$")
    return files.withColumn("hash", F.sha2(F.concat_ws("\x00", F.lit(READERS), F.coalesce("lang", F.lit("")), component.cast("string"), F.coalesce("content", F.lit(""))), 256))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{STORED}, part string")
    return spark.read.schema(f"{STORED}, part string").parquet(path)


def add_missing(files: DataFrame, path: str, parsers: dict[str, Callable[[str, str], list[dict]]] | None = None) -> None:
    """Parse the contents that the store at ``path`` lacks, each once, and append them.

    Hashes meet the store's column of hashes alone. Two writers may add one content twice; readers take it once.
    """
    known = hashed(files.select(*_OF_FILE, "content"))
    new = known.join(_stored(files.sparkSession, path).select("hash"), "hash", "left_anti")
    # One file stands for each content; it is parsed under its hash as a name.
    one = new.groupBy("hash").agg(F.max_by(F.struct("file", "lang", "content"), "file").alias("f"))
    named = F.concat("hash", F.regexp_extract("f.file", r"(\.[^./]*)?$", 0))
    rows = parse.parsed(one.select(F.lit("").alias("project"), named.alias("file"), "f.lang", "f.content"), parsers)
    given = rows.select(F.substring("file", 1, 64).alias("hash"), F.struct(*(c for c in rows.columns if c not in _OF_FILE)).alias("row")).groupBy("hash").agg(F.collect_list("row").alias("rows"))
    whole = one.select("hash").join(given, "hash", "left").select("hash", F.coalesce("rows", F.array().cast(ROWS)).cast(ROWS).alias("rows"), F.substring("hash", 1, 2).alias("part"))
    written(whole, "parsed-new").write.mode("append").partitionBy("part").parquet(path)


def parsed(files: DataFrame, path: str, parsers: dict[str, Callable[[str, str], list[dict]]] | None = None) -> DataFrame:
    """The rows of ``parse.parsed`` for ``files``, of which only contents that the store lacks are parsed."""
    add_missing(files, path, parsers)
    there = _stored(files.sparkSession, path).groupBy("hash").agg(F.first("rows").alias("rows"))
    met = hashed(files).select(*_OF_FILE, "hash").join(there, "hash")
    rows = met.select(*_OF_FILE, F.explode("rows").alias("r"))
    return rows.select(*(F.col(c) if c in _OF_FILE else F.col(f"r.{c}") for c in parse.FIELDS))


def directories(files: DataFrame) -> DataFrame:
    """project, directory, hash of every directory above ``files`` (project, file, hash); the root is ``.``."""
    level = files.select("project", F.col("file").alias("path"), "hash", F.size(F.split("file", "/")).alias("depth"))
    level = written(level, "leaves")
    deepest = level.agg(F.max("depth")).first()[0] or 0
    out, below = None, None
    for depth in range(deepest, 0, -1):
        children = level.filter(F.col("depth") == depth).select("project", "path", "hash", F.lit("f").alias("kind"))
        if below is not None:
            children = children.unionByName(below.filter("directory <> '.'").select("project", F.col("directory").alias("path"), "hash", F.lit("d").alias("kind")))
        parent = F.when(F.col("path").contains("/"), S.dirname(F.col("path"))).otherwise(".")
        entry = F.concat_ws("\x00", "kind", F.substring_index("path", "/", -1), "hash")
        own = children.groupBy("project", parent.alias("directory")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\x01"), 256).alias("hash"))
        below = written(own, "directories")
        out = below if out is None else out.unionByName(below)
    return out if out is not None else level.select("project", F.col("path").alias("directory"), "hash")


def changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """project, directory of ``now`` that differ from ``before`` (both of ``directories``): new ones and those with anything changed below."""
    return now.join(before, ["project", "directory", "hash"], "left_anti").select("project", "directory")


def in_changed(files: DataFrame, directories_changed: DataFrame) -> DataFrame:
    """The files whose own directory changed; those of equal subtrees are left out by the directory alone."""
    own = F.when(F.col("file").contains("/"), S.dirname(F.col("file"))).otherwise(".")
    return files.withColumn("_own", own).join(directories_changed.select("project", F.col("directory").alias("_own")), ["project", "_own"], "left_semi").drop("_own")
