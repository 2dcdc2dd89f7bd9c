"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

All of it is DataFrame functions. The words of a source form one stream: its documents in a hashed
order. The mix takes a quota of words from the front of that stream, going round again for what
exceeds the source, and cuts the quota into blocks of equal length. How many blocks of each source
an output shard gets is settled by a tree: the root holds every source's block count, and each
node deals its counts to two children by a multivariate hypergeometric draw, so that counts are
exact at every node and as random as dealing shuffled blocks would be. Blocks then go to shards in
permuted, disjoint runs, and rows are ordered by a hash inside a shard.

No task sees a whole source: documents are spread over hash buckets whatever their source, a
stream position is a bucket's offset plus a running sum inside the bucket, and only one row per
source and bucket takes part in the offsets. Sources stay a table: the driver sees their number, the
documents' and the blocks', nothing that grows with them. The tree's root is one row with an entry
for each source; further down a node has entries only for sources with blocks in it, so all leaves
together have at most one for each block. Pieces meet the tree's blocks by a sort-merge join on
source and block, which no source can heat: it has as many keys as blocks.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a
document of size 0 is returned with nothing taken; every row is a document of its own, rows that are
equal in doc_id, source and text included; an empty table gives an empty mix; other columns are
ignored or kept, whatever their names. Draws depend on the seed, ids, sizes and texts only, so
reruns agree.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm._common import as_row, table, written

#: A word, the weights in order of source, the share of all sizes, and the most a source gives.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Multipliers of the block permutation; primes, so that one that does not divide a count is coprime to it.
PRIMES = (15485863, 1299709, 999983)
#: Up to so many sources, counted first, their table is broadcast to the documents; more are joined by
#: shuffle, where the hottest source is split by the adaptive skew join.
BROADCAST_SOURCES = 50_000


def _size(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, tie (a hash of the text) and copy (from 1, of rows equal in all these)."""
    rows = docs.select("doc_id", "source", _size().alias("size"), F.xxhash64("text").alias("tie"))
    per = rows.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("copies"))
    return per.select("doc_id", "source", "size", "tie", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: sid (its place in order), source_size, target, docs.

    Shares are weights; where a share would pass ``MOST`` times the source, it stops there and the
    rest is shared again. Sources by rising cap per weight fill up first, so the level of the rest
    is the first at which the next source does not fill up.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    placed = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    everyone = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (SHARE * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(filling), F.lit(0))) / (
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(filling), F.lit(0))
    )
    levels = placed.withColumn("level", level).withColumn("holds", F.col("level") <= F.col("cap") / F.col("weight"))
    settled = F.min_by(F.when(F.col("holds"), F.col("level")), F.when(F.col("holds"), F.struct(F.col("cap") / F.col("weight"), "sid"))).over(everyone)
    return levels.withColumn("settled", settled).select(
        "source",
        F.col("sid").cast("int").alias("sid"),
        "source_size",
        "docs",
        F.when(F.col("settled") * F.col("weight") < F.col("cap"), F.col("settled") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def _uniform(*keys: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def hypergeometric(pool: F.Column, good: F.Column, draws: F.Column, u: F.Column) -> F.Column:
    """The count of good ones among ``draws`` from ``pool``, by inverting the distribution at ``u``.

    Probabilities are built from the mode outwards by their ratios. They are followed over the
    whole support or ten standard deviations either side, past which less than a double's
    precision is left.
    """
    pool, good, draws = (x.cast("double") for x in (pool, good, draws))
    low = F.greatest(F.lit(0.0), draws - (pool - good))
    high = F.least(draws, good)
    mode = F.greatest(low, F.least(high, F.floor((draws + 1) * (good + 1) / (pool + 2)).cast("double")))
    part = good / F.greatest(pool, F.lit(1.0))
    spread = F.ceil(10 * F.sqrt(F.greatest(F.lit(0.0), draws * part * (1 - part) * (pool - draws) / F.greatest(pool - 1, F.lit(1.0))))) + 10
    first, last = F.greatest(low, mode - spread).cast("long"), F.least(high, mode + spread).cast("long")
    up = lambda k: (good - k) * (draws - k) / ((k + 1) * (pool - good - draws + k + 1))
    down = lambda k: k * (pool - good - draws + k) / ((good - k + 1) * (draws - k + 1))
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

    def add(ratio):
        return lambda acc, k: F.struct((acc["w"] * ratio(k)).alias("w"), (acc["sum"] + acc["w"] * ratio(k)).alias("sum"))

    middle = mode.cast("long")
    below = F.aggregate(F.when(middle > first, F.sequence(middle, first + 1, F.lit(-1).cast("long"))).otherwise(none), start, add(down))
    above = F.aggregate(F.when(last > middle, F.sequence(middle, last - 1, F.lit(1).cast("long"))).otherwise(none), start, add(up))
    state = F.struct(below["w"].alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("pick"), (u * (1 + below["sum"] + above["sum"])).alias("goal"))
    walk = lambda acc, k: F.struct(
        (acc["w"] * up(k)).alias("w"),
        (acc["sum"] + acc["w"]).alias("sum"),
        F.coalesce(acc["pick"], F.when(acc["sum"] + acc["w"] > acc["goal"], k)).alias("pick"),
        acc["goal"].alias("goal"),
    )
    return F.aggregate(F.sequence(first, last, F.lit(1).cast("long")), state, walk, lambda acc: F.coalesce(acc["pick"], last))


def _deal(counts: F.Column, take: F.Column, seed: int, *keys: F.Column) -> F.Column:
    """array<long>: how many blocks of each entry are among ``take`` of them all, one draw per entry."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["have"])
    state = F.struct(total.alias("pool"), take.cast("long").alias("need"), F.array().cast("array<bigint>").alias("got"))

    def step(acc, x):
        got = hypergeometric(acc["pool"], x["have"], acc["need"], _uniform(F.lit(seed), *keys, x["sid"]))
        return F.transform(
            F.array(got), lambda n: F.struct((acc["pool"] - x["have"]).alias("pool"), (acc["need"] - n).alias("need"), F.concat(acc["got"], F.array(n)).alias("got"))
        )[0]

    return F.aggregate(counts, state, step, lambda acc: acc["got"])


def splitting_tree(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, sid, first, blocks: the run of a source's permuted blocks that each shard gets.

    ``counts``: sid, blocks. Levels are row-wise projections: a node's row becomes its children's
    rows. An entry of a node is a source with blocks there, and how many of its blocks lie left of it.
    """
    entry = F.struct(F.col("sid").cast("long").alias("sid"), F.col("blocks").cast("long").alias("have"), F.lit(0).cast("long").alias("left"))
    root = counts.filter("blocks > 0").agg(F.array_sort(F.collect_list(entry)).alias("counts"))
    nodes = root.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("n"), "counts")
    width, level = 1, 0
    while width < shards:
        half = F.floor(F.col("n") / 2).cast("long")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["have"])
        take = F.round(total * half / F.col("n")).cast("long")
        dealt = nodes.withColumn("half", half).withColumn("dealt", F.when(F.col("n") > 1, _deal(F.col("counts"), take, seed, F.col("lo"), F.col("n"))))
        child = lambda lo, n, have: F.struct(lo.alias("lo"), n.alias("n"), F.filter(have, lambda x: x["have"] > 0).alias("counts"))
        part = lambda x, have, left: F.struct(x["sid"].alias("sid"), have.alias("have"), left.alias("left"))
        lower = F.zip_with("counts", "dealt", lambda x, n: part(x, n, x["left"]))
        upper = F.zip_with("counts", "dealt", lambda x, n: part(x, x["have"] - n, x["left"] + n))
        both = F.array(child(F.col("lo"), F.col("half"), lower), child(F.col("lo") + F.col("half"), F.col("n") - F.col("half"), upper))
        same = F.array(child(F.col("lo"), F.col("n"), F.col("counts")))
        nodes = dealt.select(F.explode(F.when(F.col("n") > 1, both).otherwise(same)).alias("c")).select("c.*")
        width, level = width * 2, level + 1
        if level % 8 == 0:
            nodes = nodes.repartition("lo")
    return nodes.select(F.col("lo").alias("shard"), F.explode("counts").alias("x")).select(
        "shard", F.col("x.sid").alias("sid"), F.col("x.left").alias("first"), F.col("x.have").alias("blocks")
    )


def streams(sized: DataFrame, sources: DataFrame, docs: int, few: bool, seed: int, docs_per_bucket: int = 2000) -> DataFrame:
    """Every document with its place in the stream of its source: ``begin``, and the source's row."""
    buckets = max(256, ceil(docs / docs_per_bucket))
    there = sources.select(F.col("source").alias("_source"), F.col("sid").cast("long").alias("sid"), "source_size", "target", "quota")
    rows = sized.join(F.broadcast(there) if few else there.hint("merge"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tie", "copy"), F.lit(buckets)).cast("int"))
    per = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    offsets = per.select(
        "sid", "bucket", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("bucket", "sid").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "tie", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(offsets, ["bucket", "sid"]).withColumn("begin", F.col("offset") + F.col("before")).drop("offset", "before", "bucket")


def mix(docs: DataFrame, block_words: int = 4096, shard_blocks: int = 256, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The documents placed in their streams, and the pieces of the mix.

    A piece: shard, place (order inside the shard), doc_id, source, tie, copy, word_start, word_end
    (the words of the document that it takes), pass (0, or 1 for the second time round).
    """
    return _mix(written(sizes(docs), "mix-sizes"), block_words, shard_blocks, seed)


def _mix(sized: DataFrame, block_words: int, shard_blocks: int, seed: int) -> tuple[DataFrame, DataFrame]:
    blocks = F.ceil(F.col("quota") / block_words).cast("long")
    sources = written(source_targets(sized).withColumn("quota", F.round("target").cast("long")).withColumn("blocks", blocks), "mix-sources")
    told = sources.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks")).first()
    placed = streams(sized, sources, told["docs"], told["sources"] <= BROADCAST_SOURCES, seed)
    tree = splitting_tree(sources.select("sid", "blocks"), max(1, ceil(told["blocks"] / shard_blocks)), seed)
    runs = tree.select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("drawn"))
    ends = placed.select("doc_id", "source", "tie", "copy", "sid", "size", "source_size", "quota", "begin", F.explode(F.array(*(F.lit(e).cast("long") for e in range(MOST)))).alias("pass"))
    ends = ends.withColumn("from", F.col("pass") * F.col("source_size") + F.col("begin")).withColumn("to", F.least(F.col("from") + F.col("size"), "quota")).filter("to > from")
    block = lambda c: F.floor(c / block_words).cast("long")
    cut = ends.withColumn("block", F.explode(F.sequence(block(F.col("from")), block(F.col("to") - 1))))
    edge = F.col("block") * block_words
    factor = F.coalesce(*(F.when(blocks % p != 0, F.lit(p)) for p in PRIMES), F.lit(1)).cast("long")
    cut = cut.select(
        "doc_id",
        "source",
        "tie",
        "copy",
        "size",
        "sid",
        "pass",
        F.pmod(F.col("block") * factor, blocks).alias("drawn"),
        (F.greatest(F.col("from"), edge) - F.col("from")).alias("word_start"),
        (F.least(F.col("to"), edge + block_words) - F.col("from")).alias("word_end"),
    )
    # One row for each block of the mix: too many to broadcast, and more than the planner can tell.
    pieces = cut.join(runs.hint("merge"), ["sid", "drawn"]).withColumn("place", F.xxhash64(F.lit(seed + 2), "doc_id", "tie", "copy", "pass", "word_start"))
    return placed, pieces.select("shard", "place", "doc_id", "source", "tie", "copy", "size", "pass", "word_start", "word_end")


def first_words(text: F.Column, n: F.Column) -> F.Column:
    """The text up to the end of its n-th word, white space as it is."""
    runs = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(runs, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, block_words: int = 4096, shard_blocks: int = 256, seed: int = 7) -> DataFrame:
    """The documents as the mix takes them: one row per document and pass, cut where the quota ends.

    Columns are those of ``docs``. A document the mix does not take is gone; one that it takes
    twice is there twice. ``n_chars`` follows the text where it was cut.
    """
    sized = written(sizes(docs), "mix-sizes")
    _, pieces = _mix(sized, block_words, shard_blocks, seed)
    names, own = ("doc_id", "source", "tie"), ("d", "s", "t")
    renamed = [F.col(a).alias(b) for a, b in zip(names, own, strict=True)]
    each = pieces.groupBy(*names, "copy", "pass", "size").agg(F.sum(F.col("word_end") - F.col("word_start")).alias("words"))
    # Equal rows are alike, so it is enough how many of them a pass takes whole, and how much of one more.
    whole = lambda p: F.count_if((F.col("pass") == p) & (F.col("words") == F.col("size"))).alias(f"whole{p}")
    part = lambda p: F.coalesce(F.max(F.when((F.col("pass") == p) & (F.col("words") < F.col("size")), F.col("words"))), F.lit(0).cast("long")).alias(f"part{p}")
    taken = each.select(*renamed, "pass", "size", "words").groupBy(*own, "size").agg(*(f(p) for p in range(MOST) for f in (whole, part)))
    takes = F.array(*(F.when(F.col("copy") <= F.col(f"whole{p}"), F.col("size")).when(F.col("copy") == F.col(f"whole{p}") + 1, F.col(f"part{p}")).otherwise(0) for p in range(MOST)))
    rows = as_row(docs).select("row", F.col("row.doc_id").alias("d"), F.col("row.source").alias("s"), F.xxhash64("row.text").alias("t"))

    def met(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        same = F.col("a.d").eqNullSafe(F.col("b.d")) & F.col("a.s").eqNullSafe(F.col("b.s")) & (F.col("a.t") == F.col("b.t"))
        joined = a.join(b, same, how)
        return joined if how != "inner" else joined.select("a.*", *(F.col(f"b.{c}") for c in right.columns if c not in own))

    repeated = sized.filter("copy = 2").select(*renamed)
    if repeated.isEmpty():
        chosen = met(rows, taken).withColumn("copy", F.lit(1))
    else:
        # Texts move once: only rows that have equals are numbered, which takes a second look at the table.
        one = met(rows, met(taken, repeated, "left_anti")).withColumn("copy", F.lit(1))
        several = met(rows, repeated, "left_semi").withColumn("copy", F.row_number().over(Window.partitionBy(*own).orderBy("t")))
        chosen = one.unionByName(met(several, taken), allowMissingColumns=True)
    chosen = chosen.select("row", "size", F.explode(F.filter(takes, lambda n: n > 0)).alias("words"))
    text = F.when(F.col("words") < F.col("size"), first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    cut = chosen.select(F.col("row").withField("text", text).alias("row"), (F.col("words") < F.col("size")).alias("cut"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("cut"), F.char_length("row.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        cut = cut.withColumn("row", F.col("row").withField("n_chars", n_chars))
    return cut.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, pieces = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    zero = F.lit(0).cast("long")
    own = ("doc_id", "source", "tie", "copy")
    every = placed.select(*own, "size", "source_size", "target", zero.alias("taken"), zero.alias("pieces")).unionByName(
        pieces.select(
            *own, zero.alias("size"), zero.alias("source_size"), F.lit(0.0).alias("target"), (F.col("word_end") - F.col("word_start")).alias("taken"), F.lit(1).cast("long").alias("pieces")
        )
    )
    return every.groupBy(*own).agg(
        F.sum("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.sum("pieces").alias("n_pieces")
    ).drop("source", "tie", "copy")
