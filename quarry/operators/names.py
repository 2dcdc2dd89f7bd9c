"""Name occurrence search by an inverted index instead of one pattern per name and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.shared import written

TOKEN = r"[A-Za-z0-9_]+"
TOKEN_JS = r"[A-Za-z0-9_$]+"


def _tokens(text: Column, token: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({token})"), 1)


def index(files: DataFrame, token: str = TOKEN, least: int = 1) -> DataFrame:
    """project, file, token, n: how often each token occurs in each file."""
    each = files.select("project", "file", F.explode(_tokens(F.col("content"), token)).alias("token"))
    return each.filter(F.length("token") >= least).groupBy("project", "file", "token").agg(F.count(F.lit(1)).alias("n"))


def lookup(files: DataFrame, wanted: DataFrame, token: str = TOKEN) -> DataFrame:
    """name, occurrences, files of the wanted names (project, name). Other tokens leave before anything is counted or shuffled by name."""
    each = files.select("project", "file", F.explode(F.regexp_extract_all("content", F.lit(f"({token})"), 1)).alias("name"))
    found = each.join(wanted.select("project", "name").distinct(), ["project", "name"], "left_semi")
    per_file = found.groupBy("project", "name", "file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("project", "name").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files"))


def named_elsewhere(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """The rows of ``names`` (project, file, name, ...) that occur in another file of the project."""
    other = tokens.select("project", F.col("token").alias("name"), F.col("file").alias("_other"))
    low_high = other.groupBy("project", "name").agg(F.min("_other").alias("_low"), F.max("_other").alias("_high"))
    found = names.join(low_high, ["project", "name"])
    return found.filter((F.col("_low") != F.col("file")) | (F.col("_high") != F.col("file"))).drop("_low", "_high")


def _rest(rows: DataFrame, own: Column, alone: DataFrame) -> DataFrame:
    sizes = rows.select("project", "file", F.coalesce(F.size(own), F.lit(0)).cast("long").alias("_all")).join(alone, ["project", "file"], "left")
    return sizes.select("project", "file", (F.col("_all") - F.coalesce("_alone", F.lit(0))).alias("names")).filter("names > 0")


def counts_elsewhere(files: DataFrame, token: str = TOKEN) -> DataFrame:
    """project, file, names: how many of a file's distinct tokens occur in another file of the project, where any does.

    These are all of the file's but those that it alone has, and for either number no pair of file and
    token is moved: a token's first and last file are found in part before the shuffle, and the file's
    own number in its row. Files given in several rows, and rows without a file (one group, and no
    other file to anyone), have their pairs joined instead.
    """
    rows, own = files.filter("content IS NOT NULL"), F.array_distinct(_tokens(F.col("content"), token))
    each = rows.select("project", "file", F.explode(own).alias("name"))
    spans = each.groupBy("name", "project").agg(F.min("file").alias("_low"), F.max("file").alias("_high"))
    alone = spans.filter("_low = _high").groupBy("project", F.col("_low").alias("file")).agg(F.count(F.lit(1)).alias("_alone"))
    several = files.groupBy("project", "file").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1 OR file IS NULL")
    # Written, so that the planner knows how few they are and moves no text to meet them.
    several = written(several.select(F.col("project").alias("_p"), F.col("file").alias("_f")), "several-rows")
    if several.isEmpty():
        return _rest(rows, own, alone)
    theirs = F.col("project").eqNullSafe(F.col("_p")) & F.col("file").eqNullSafe(F.col("_f"))
    plain = _rest(rows.join(several, theirs, "left_anti"), own, alone)
    pairs = each.join(several, theirs, "left_semi").distinct().join(spans.filter("_low <> _high"), ["project", "name"], "left_semi")
    return plain.unionByName(pairs.groupBy("project", "file").agg(F.count(F.lit(1)).alias("names")))


def unreferenced(functions: DataFrame, tokens: DataFrame, allowed: int = 1) -> DataFrame:
    """Functions (project, file, name, ...) whose name occurs at most ``allowed`` times in the project."""
    total = tokens.groupBy("project", F.col("token").alias("name")).agg(F.sum("n").alias("occurrences"))
    found = functions.join(total, ["project", "name"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
    return found.filter(F.col("occurrences") <= allowed)
