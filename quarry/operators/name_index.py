"""A kept inverted index of names: posting blocks by token, added to by changed files.

Every version of a file has a number. Its tokens' postings are appended in blocks: for a token and
a run of ``RUN`` numbers, the offsets of the files in the run and how often the token occurs in
each; the run says which numbers a block can hold. Blocks lie in ``BUCKETS`` folders by a hash of project and token,
in token order, so a lookup opens the folders of the wanted tokens and, by the blocks' own bounds, of
these only what may hold them. Nothing is rewritten: postings of a file's former versions stay, and
are left out because the table of versions knows which are current. ``compact`` drops them.

Defined cases: a file with null content has no tokens; of a file given twice in one update one row is
taken; removing a file that is not there changes nothing; a missing index is an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.names import TOKEN
from quarry.shared import written
from quarry.shipping import ship

BUCKETS = 64
RUN = 1 << 14
#: Tokens whose blocks a task makes at a time; one file is the least.
TOKENS = 1 << 21
VERSIONS = "project string, file string, number long, version long, hash string"
POSTINGS = "project string, token string, run long, offsets array<int>, counts array<long>, bucket int"


def _bucket(project: Column, token: Column) -> Column:
    return F.pmod(F.xxhash64(project, token), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """project, file, number, version, hash of the files as they are now."""
    last = F.max_by(F.struct("number", "version", "hash"), "version").alias("v")
    return _table(spark, f"{path}/versions", VERSIONS).groupBy("project", "file").agg(last).select("project", "file", "v.*").filter("hash IS NOT NULL")


def _own_blocks(run_files: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the rows (project, number, tokens) that a task has at a time, in Arrow and numpy.

    Token, group of project and run, and row are one number for each token, and these are sorted and
    counted. An offset and its count, which is below 2^31 as a text's length is, are one number too.
    """

    def blocks_of(part: pa.RecordBatch) -> pa.RecordBatch:
        lists, rows = part.column(2), part.num_rows
        tokens, projects = lists.flatten().dictionary_encode(), part.column(0).dictionary_encode(null_encoding="encode")
        runs, places = np.divmod(part.column(1).to_numpy(), run_files)
        groups, group = np.unique(np.stack([projects.indices.to_numpy(), runs]), axis=1, return_inverse=True)
        row = np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        keys, n = np.unique((tokens.indices.to_numpy().astype("i8") * groups.shape[1] + group.ravel()[row]) * rows + row, return_counts=True)
        block, row = np.divmod(keys, rows)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        token, own = np.divmod(block[starts], groups.shape[1])
        packed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype("i4")), pa.array((places[row] << 32) | n))
        return pa.RecordBatch.from_arrays([projects.dictionary.take(pa.array(groups[0][own])), tokens.dictionary.take(pa.array(token)), pa.array(groups[1][own]), packed], ["project", "token", "run", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(), dtype="i8")
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOKENS, side="right")))
                yield blocks_of(batch.slice(start, stop - start))
                start = stop

    return run


def _postings(rows: DataFrame, token: str) -> DataFrame:
    """Blocks of ``rows`` (project, number, content), one row for each number.

    Neighbouring numbers are read by one task, so a run's blocks are mostly made there, and no pair of
    file and token is shuffled. Token comes first, as rows are sorted by it.
    """
    ship(rows.sparkSession)
    tokens = rows.select("project", "number", F.regexp_extract_all("content", F.lit(f"({token})"), 1).alias("tokens"))
    own = tokens.mapInArrow(_own_blocks(RUN), "project string, token string, run long, p array<long>")
    blocks = own.groupBy("token", "project", "run").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
    offsets, counts = F.transform("p", lambda x: F.shiftright(x, 32).cast("int")), F.transform("p", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)))
    return blocks.select("project", "token", "run", offsets.alias("offsets"), counts.alias("counts"), _bucket(F.col("project"), F.col("token")).alias("bucket"))


def update(files: DataFrame, path: str, removed: DataFrame | None = None, token: str = TOKEN) -> int:
    """Take in ``files`` (project, file, content) that are new or changed, and leave out ``removed`` (project, file); how many were indexed.

    Only texts whose hash is new are split into tokens.
    """
    spark = files.sparkSession
    known = current(spark, path)
    given = files.groupBy("project", "file").agg(F.max("content").alias("content")).withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    fresh = given.join(known.select("project", "file", "hash"), ["project", "file", "hash"], "left_anti").select("project", "file", "hash", "content")
    # The task and place that wrote a row are written with it, so its number is the same whenever it is read.
    fresh = written(fresh.withColumn("_at", F.monotonically_increasing_id()), "index-fresh")
    version = (_table(spark, f"{path}/versions", VERSIONS).agg(F.max("version")).first()[0] or 0) + 1
    # Numbers are dense within an update's tasks and rise from update to update.
    top = _table(spark, f"{path}/versions", VERSIONS).agg(F.max("number")).first()[0]
    start = 0 if top is None else (top // RUN + 1) * RUN
    sizes = {r["p"]: r["n"] for r in fresh.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = {}, start
    for p in sorted(sizes):
        before[p] = at
        at += sizes[p]
    place = F.create_map(*(F.lit(v) for p, n in before.items() for v in (p, n)))[F.shiftright("_at", 33)] if before else F.lit(0)
    numbered = fresh.withColumn("number", (place + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")
    _postings(numbered, token).repartition("bucket").sortWithinPartitions("bucket", "token", "run").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    told = numbered.select("project", "file", "number", F.lit(version).cast("long").alias("version"), "hash")
    if removed is not None:
        gone = removed.select("project", "file").distinct().join(known.select("project", "file"), ["project", "file"], "left_semi").join(numbered.select("project", "file"), ["project", "file"], "left_anti")
        told = told.unionByName(gone.select("project", "file", F.lit(-1).cast("long").alias("number"), F.lit(version).cast("long").alias("version"), F.lit(None).cast("string").alias("hash")))
    told.write.mode("append").parquet(f"{path}/versions")
    return sum(sizes.values())


def postings(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """project, name, number, n of the wanted names (project, name), former versions included.

    The wanted names' buckets, ``BUCKETS`` at most, are fetched first, so that the scan is of their folders alone.
    """
    names = wanted.select("project", F.col("name").alias("token")).distinct()
    buckets = [r[0] for r in names.select(_bucket(F.col("project"), F.col("token"))).distinct().collect()]
    blocks = _table(spark, f"{path}/postings", POSTINGS).filter(F.col("bucket").isin(buckets))
    met = blocks.join(names.withColumn("bucket", _bucket(F.col("project"), F.col("token"))), ["bucket", "project", "token"], "left_semi")
    each = met.select("project", F.col("token").alias("name"), "run", F.explode(F.arrays_zip("offsets", "counts")).alias("p"))
    return each.select("project", "name", (F.col("run") * RUN + F.col("p.offsets")).alias("number"), F.col("p.counts").alias("n"))


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """name, occurrences, files of the wanted names, as ``names.lookup`` gives them from the texts."""
    live = postings(spark, path, wanted).join(current(spark, path).select("project", "number"), ["project", "number"], "left_semi")
    return live.groupBy("project", "name").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files"))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The index at ``path`` without former versions, written as a new one at ``to``; blocks of one token and run become one."""
    live = current(spark, path)
    blocks = _table(spark, f"{path}/postings", POSTINGS)
    each = blocks.select("project", "token", "run", "bucket", F.explode(F.arrays_zip("offsets", "counts")).alias("p")).withColumn("number", F.col("run") * RUN + F.col("p.offsets"))
    kept = each.join(live.select("project", "number"), ["project", "number"], "left_semi").groupBy("project", "token", "run", "bucket").agg(F.array_sort(F.collect_list("p")).alias("p"))
    out = kept.select("project", "token", "run", F.col("p.offsets").alias("offsets"), F.col("p.counts").alias("counts"), "bucket")
    out.repartition("bucket").sortWithinPartitions("bucket", "token", "run").write.partitionBy("bucket").parquet(f"{to}/postings")
    live.select("project", "file", "number", "version", "hash").write.parquet(f"{to}/versions")
