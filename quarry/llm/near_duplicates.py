"""Near-duplicate classes: DartMinHash signatures, banded joining, exact links, components.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more;
a class is what links connect. Texts with equal shingle sets are one representative from the
start, so copies are never paired. Signatures of 96 coordinates make 24 bands of 4; two texts with
a similarity of 0.8 share none of them with a probability of 3 in a million.

Each bucket of a band is settled exactly, whatever its size; buckets with the same members are
settled once. In a group the shared shingles of all members give all their intersections as matrix
products, and what leaves it is a spanning forest of its links. The first bands are settled before
the others: what they link makes classes, and of the other bands' buckets only those that hold
several classes are looked at, and only across them. A cluster of near copies so goes through a few
bands, not all. A bucket of up to ``BLOCK`` members is one group. Larger ones take three steps, none
of which grows with the square of a bucket:

1. Each member meets ``BLOCK`` members that a hash picks as the bucket's pivots, in blocks. What is
   linked so far makes classes; a bucket of one class is done with, as large groups of near copies are.
2. Members of the others form one exact similarity join by prefix filter: shingles are ordered by how
   few members have them, and two sets that are similar enough share one of their first 20 %. What
   unlike texts have in common is common to many, so it is not among those.
3. The members that share such a shingle are compared across classes only, in blocks of one large
   class or of several small ones.

Defined cases: a null text, or one without words, is like no other and is its own class; a text of
fewer than five words is one shingle; a null doc_id has a null class; rows of equal doc_id and text
are one document; an empty table gives an empty result; other columns are ignored or kept,
whatever their names. A class is named by its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm._common import as_row, lean, only, small_batches, table, written
from quarry.llm.dart_minhash import signatures
from quarry.llm.shingles import mixed, shingle_sets

SIZE, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
#: Bands that are settled first.
FIRST = 6
BLOCK = 512
#: Columns of one matrix product.
CHUNK = 4096

_U = np.uint64
Weights = Callable[[np.ndarray], np.ndarray]


def unit_weights(counts: np.ndarray) -> np.ndarray:
    """Weights that make the similarity that of plain sets; any function of the counts may take its place."""
    return np.ones(len(counts))


def _fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    one, two = mixed(elements ^ _U(0x2545F4914F6CDD1D)), mixed(elements ^ _U(0x9FB21C651E98DF25))
    return tuple(int(x.sum(dtype="u8").astype("i8")) for x in (one, two))


def _sign(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("near-duplicates")
        for batch in batches:
            for k in range(0, batch.num_rows, 300):
                part = batch.slice(k, 300)
                sets = shingle_sets(part.column(1).to_pylist(), SIZE)
                signed = signatures([(e, weights(c)) for e, c in sets], BANDS * ROWS).reshape(len(sets), BANDS, ROWS)
                folded = np.zeros((len(sets), BANDS), "u8")
                for r in range(ROWS):
                    folded = mixed(folded * _U(31) + signed[:, :, r])
                prints = [_fingerprint(e) for e, _ in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array([len(e) for e, _ in sets], pa.int64()),
                        pa.FixedSizeListArray.from_arrays(pa.array(folded.view("i8").ravel()), BANDS).cast(pa.list_(pa.int64())),
                    ],
                    ["doc_id", "s1", "s2", "n", "bands"],
                )

    return run


def signed(docs: DataFrame, weights: Weights = unit_weights) -> DataFrame:
    """doc_id, s1 and s2 (a fingerprint of the shingle set), n (its size), bands."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(_sign(weights)), "doc_id long, s1 long, s2 long, n long, bands array<long>")


#: Bits of the filter for each id that it is made for, and the most ids it is made for: 32 MB of bits.
#: More ids take a semi-join instead, which gives the same rows.
ID_BITS, MOST_IDS = 16, 1 << 24


class IdFilter:
    """A bitmap, sized by their number, in which every id given has its bit."""

    def __init__(self, ids: DataFrame, n: int):
        self.size = 1 << max(16, (ID_BITS * max(n, 1) - 1).bit_length())
        told = ids.mapInArrow(lean(self._bits), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        bits = np.zeros(self.size // 64, "i8")
        bits[told.column("at").to_numpy()] = told.column("word").to_numpy()
        self.sent = ids.sparkSession.sparkContext.broadcast(bits.view("u8"))

    def __getstate__(self):
        return {"size": self.size, "sent": getattr(self, "sent", None)}

    def _places(self, ids: np.ndarray) -> np.ndarray:
        return (mixed(ids.astype("i8").view("u8")) % _U(self.size)).astype("i8")

    def _bits(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(self.size // 64, "u8")
        for batch in batches:
            places = self._places(batch.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, places >> 6, _U(1) << (places & 63).astype("u8"))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view("i8"))], ["at", "word"])

    def may_have(self, ids: np.ndarray) -> np.ndarray:
        places = self._places(ids)
        return (self.sent.value[places >> 6] >> (places & 63).astype("u8") & _U(1)).astype(bool)


def _sets(wanted: IdFilter | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.may_have(batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False))))
            for k in range(0, batch.num_rows, 300):
                part = batch.slice(k, 300)
                sets = [e for e, _ in shingle_sets(part.column(1).to_pylist(), SIZE)]
                prints = [_fingerprint(e)[0] for e in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(prints, pa.int64()), pa.array([e.tobytes() for e in sets], pa.binary())], ["rep", "s1", "shingles"]
                )

    return run


def sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """rep, s1, shingles of the ``members`` (rep, s1) and perhaps of some others: the caller joins.

    Texts stay where they are: a bitmap settles which sets to make.
    """
    ids = members.select("rep").distinct()
    n = ids.count()
    rows = docs.select("doc_id", "text")
    if n <= MOST_IDS:
        made = rows.mapInArrow(lean(_sets(IdFilter(ids, n))), "rep long, s1 long, shingles binary")
    else:
        made = rows.join(ids, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(lean(_sets(None)), "rep long, s1 long, shingles binary")
    return made.dropDuplicates(["rep", "s1"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from the shingles that more than one set has."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[code]
    owner, column = owner[keep], place[code[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), "f8")
    for first in range(0, int(shared.sum()), CHUNK):
        a, b = np.searchsorted(column, [first, first + CHUNK])
        block = np.zeros((len(sets), CHUNK), "f4")
        block[owner[a:b], column[a:b] - first] = 1
        out += block @ block.T
    return out


def links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of a group's links, as (smallest id of the tree, id)."""
    sizes = np.array([len(s) for s in sets], "f8")
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = [(0, 1)] if common >= least * (sizes.sum() - common) else []
    else:
        common = intersections(sets)
        near = common >= least * (sizes[:, None] + sizes[None, :] - common)
        if len(np.unique(sides)) > 1:
            near &= sides[:, None] != sides[None, :]
        linked = np.argwhere(np.triu(near, 1)).tolist()
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if ids[a] > ids[b]:
            a, b = b, a
        root[b] = a
    return [(int(ids[find(k)]), int(ids[k])) for k in range(len(sets)) if ids[find(k)] != ids[k]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a group (key, a, b) follow each other."""
    group, at = {}, None

    def settled() -> pa.RecordBatch | None:
        if len({rep for rep, _ in group}) < 2:
            return None
        once = list(group.values())
        found = links(np.array([g[0] for g in once]), np.array([g[1] for g in once]), [np.frombuffer(g[2], "u8") for g in once])
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"]) if found else None

    for batch in batches:
        key, a, b, side, rep, s1 = (batch.column(k).to_pylist() for k in range(6))
        for k, cell in enumerate(batch.column(6)):
            if (key[k], a[k], b[k]) != at:
                if (done := settled()) is not None:
                    yield done
                group, at = {}, (key[k], a[k], b[k])
            if (rep[k], s1[k]) not in group:
                group[rep[k], s1[k]] = (rep[k], side[k], cell.as_py())
    if (done := settled()) is not None:
        yield done


def _linked(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """u < v: links inside each group (key, a, b), across sides where it has several."""
    held = groups.join(sets_of(docs, groups), ["rep", "s1"]).select("key", "a", "b", "side", "rep", "s1", "shingles")
    return held.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(lean(_link), "u long, v long").distinct()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set's shingles, given with the number of sets that have them, the first few in rising order of that."""
    for batch in batches:
        out: list[tuple] = []
        for rep, s1, label, n, pairs in zip(*(batch.column(k) for k in range(5)), strict=True):
            flat = np.array([(p["count"], p["e"]) for p in pairs.as_py()], "i8").reshape(-1, 2)
            # Those that no other set has are not sent: they come first and take up their places.
            room = n.as_py() - int(np.ceil(LEAST * n.as_py() - 1e-9)) + 1 - (n.as_py() - len(flat))
            for e in flat[np.lexsort((flat[:, 1], flat[:, 0]))[: max(0, room)], 1].tolist():
                out.append((e, rep.as_py(), s1.as_py(), label.as_py()))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "rep", "s1", "label"])


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 100):
            part = batch.slice(k, 100)
            sets = [np.frombuffer(c.as_buffer(), "i8") for c in part.column(3)]
            sizes = np.array([len(x) for x in sets])
            held = [np.repeat(part.column(c).to_numpy(), sizes) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*(pa.array(h) for h in held), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets))], ["rep", "s1", "label", "n", "e"])


#: Rows up to which a table is broadcast once they are counted: some 4 MB.
SMALL = 100_000


def _counted(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and broadcast if it is small: what it is joined to then need not be dealt by a key that may be hot."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= SMALL else out


def prefix_groups(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Groups (key, a, b, side, rep, s1) that hold every pair of similar enough ``members`` (rep, s1, label) of different labels.

    ``key`` is a shingle that the pair shares among its first; the side is the label.
    """
    sets = members.join(sets_of(docs, members), ["rep", "s1"]).select("rep", "s1", "label", "shingles")
    each = written(sets.mapInArrow(lean(_exploded), "rep long, s1 long, label long, n long, e long"), "shingles")
    # A shingle that only one label has can't link two.
    shared = each.groupBy("e").agg(F.count(F.lit(1)).alias("count"), F.min("label").alias("low"), F.max("label").alias("high")).filter("count > 1")
    known = each.join(shared, "e").groupBy("rep", "s1", "label", "n").agg(F.collect_list(F.struct("count", "e")).alias("pairs"))
    first = known.mapInArrow(lean(_prefixes), "key long, rep long, s1 long, label long")
    across = shared.filter("low < high").select(F.col("e").alias("key"))
    first = written(first.join(across, "key", "left_semi"), "prefixes")
    per = written(first.groupBy("key", "label").agg(F.count(F.lit(1)).alias("own")), "own")
    small = F.sum(F.when(F.col("own") <= BLOCK, F.col("own")).otherwise(0))
    totals = per.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.ceil(small / BLOCK).cast("long").alias("bins")).filter("labels > 1").drop("labels")
    large = F.col("own").isNotNull()
    sub = F.pmod(F.xxhash64(F.lit(3), "rep"), F.ceil(F.col("own") / BLOCK).cast("long"))
    dealt = first.join(_counted(per.filter(F.col("own") > BLOCK), "large"), ["key", "label"], "left").join(_counted(totals, "totals"), "key").select(
        "key", "rep", "s1", "label", F.when(large, F.col("label")).alias("large"),
        F.when(large, F.xxhash64("label", sub)).otherwise(F.pmod(F.xxhash64(F.lit(4), "label"), F.greatest("bins", F.lit(1)))).alias("block"),
    )
    dealt = written(dealt, "dealt")
    one = dealt.select("key", F.col("block").alias("a"), F.col("large").alias("la")).distinct()
    two = dealt.select("key", F.col("block").alias("b"), F.col("large").alias("lb")).distinct()
    met = one.join(two, "key").filter("a <= b AND NOT coalesce(la = lb, false)").select("key", "a", "b")
    sides = met.select("key", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return dealt.join(sides, ["key", "block"]).select("key", "a", "b", F.col("label").alias("side"), "rep", "s1")


def _members(rows: DataFrame) -> DataFrame:
    """key, m, side, rep, s1, label: the members of every bucket of ``rows`` (key, rep, s1, label) that holds several labels, equal buckets once."""
    print_ = lambda *seed: F.bit_xor(F.xxhash64(*map(F.lit, seed), "rep", "s1"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), print_().alias("x"), print_(1).alias("y"), F.min("label").alias("low"), F.max("label").alias("high"))
    once = buckets.filter("low < high").groupBy("m", "x", "y").agg(F.min("key").alias("key"))
    members = rows.join(once.select("key", "m"), "key").withColumn("side", F.pmod(F.xxhash64(F.lit(2), "rep"), F.ceil(F.col("m") / BLOCK).cast("int")).cast("long"))
    return written(members.select("key", "m", "side", "rep", "s1", "label"), "members")


def _settled(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links of each bucket: all across labels where it is one group, those with its pivots where it is several."""
    zero = F.lit(0).cast("long")
    # Side 0 are the pivots, which meet every block; the others meet them only.
    last = F.when(F.col("side") == 0, F.ceil(F.col("m") / BLOCK).cast("long") - 1).otherwise(F.col("side"))
    groups = members.withColumn("b", F.explode(F.sequence(F.col("side"), last)))
    across = F.when(F.col("m") <= BLOCK, F.col("label")).otherwise(F.col("side"))
    return written(_linked(groups.select("key", zero.alias("a"), "b", across.alias("side"), "rep", "s1"), docs), "links")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    labels = components(found).select(F.col("node").alias("rep"), "label")
    return rows.drop("label").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def bucket_links(docs: DataFrame, sig: DataFrame, reps: DataFrame) -> DataFrame:
    """u < v: links that connect whatever the links inside all buckets connect."""
    own = sig.join(reps, (F.col("doc_id") == F.col("rep")) & (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")))
    # Repeated rows are one member: what enters a bucket twice would cancel in the xor that tells buckets apart.
    own = own.groupBy(F.col("doc_id").alias("rep"), "s1", "s2").agg(F.min("bands").alias("bands"))
    rows = own.select("rep", "s1", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "band", "rep", "s1", F.col("rep").alias("label"))
    early = _members(rows.filter(F.col("band") < FIRST))
    found = _settled(docs, early)
    late = _members(_labelled(rows.filter(F.col("band") >= FIRST), found))
    found = found.unionByName(_settled(docs, late))
    large = early.unionByName(late).filter(F.col("m") > BLOCK)
    if large.isEmpty():
        return found.distinct()
    labelled = _labelled(large, found)
    open_still = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    rest = written(labelled.join(open_still, "key", "left_semi").select("rep", "s1", "label").distinct(), "unlike")
    if not rest.isEmpty():
        found = found.unionByName(_linked(written(prefix_groups(docs, rest), "groups"), docs))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each is connected to. Nodes are those of ``edges``.

    Each round takes the smallest label among neighbours, then the label of that label, so chains
    halve; rounds end when no label changes. Lineage ends in the shared folder every round.
    """
    both = written(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        after = written(after, "labels")
        labels = after.select("node", "label")
        if after.filter("label < old").isEmpty():
            return labels


def _named(docs: DataFrame, weights: Weights = unit_weights) -> DataFrame:
    """doc_id, s1, s2, n, class_id: one row for each row of ``docs`` (doc_id, text)."""
    sig = written(signed(docs, weights), "signed")
    worded = sig.filter("n > 0 AND doc_id IS NOT NULL")
    reps = written(worded.groupBy(F.col("s1").alias("r1"), F.col("s2").alias("r2")).agg(F.min("doc_id").alias("rep")), "reps")
    labels = components(written(bucket_links(docs, sig, reps), "links"))
    named = reps.join(labels, F.col("rep") == F.col("node"), "left").select("r1", "r2", F.coalesce("label", "rep").alias("_class"))
    same = (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")) & (F.col("n") > 0)
    return sig.select("doc_id", "s1", "s2", "n").join(named, same, "left").select(
        "doc_id", "s1", "s2", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("_class", "doc_id")).alias("class_id")
    )


def classes(docs: DataFrame, weights: Weights = unit_weights) -> DataFrame:
    """doc_id, class_id, n_shingles: one row for each row of ``docs`` (doc_id, text)."""
    return _named(docs, weights).select("doc_id", "class_id", F.col("n").alias("n_shingles"))


def _printed(wanted: IdFilter):
    """Whole rows, with their fingerprints, whose id has its bit or is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).field("doc_id").cast(pa.int64())
            may = wanted.may_have(ids.fill_null(0).to_numpy(zero_copy_only=False))
            rows = batch.column(0).filter(pa.array(may | ids.is_null().to_numpy(zero_copy_only=False)))
            for k in range(0, len(rows), 300):
                part = rows.slice(k, 300)
                sets = [e for e, _ in shingle_sets(part.field("text").to_pylist(), SIZE)]
                prints = [_fingerprint(e) for e in sets]
                made = [pa.array(c, pa.int64()) for c in ([p[0] for p in prints], [p[1] for p in prints], [len(e) for e in sets])]
                yield pa.RecordBatch.from_arrays([part.field("doc_id").cast(pa.int64()), *made, part], ["id", "s1", "s2", "n", "row"])

    return run


def _apart(wanted: IdFilter, inside: bool):
    """Whole rows whose id may be among those wanted, or is null; or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).field("doc_id").cast(pa.int64())
            may = wanted.may_have(ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(may == inside))

    return run


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their class, columns as they were.

    Of rows with equal doc_id and shingle set one stays, with the smallest text (among equal texts,
    any). Rows with a null doc_id are in no class: one of those with equal sets stays, and all
    without words.

    Texts stay where they are: a bitmap of the ids that go, or that several rows have, settles for
    most rows that they stay; only the others are joined. Beyond ``MOST_IDS`` such ids all are.
    """
    named = written(_named(docs), "classes")
    ids = named.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("kept")).agg(F.count(F.lit(1)).alias("rows"), F.bool_or(F.expr("doc_id = class_id")).alias("names"))
    ids = written(ids, "kept")
    row = as_row(docs)
    others = ids.filter("NOT (rows = 1 AND names)").select("kept")
    n = others.count()
    if not n and named.filter("doc_id IS NULL").isEmpty():
        return docs
    rest = row
    if n <= MOST_IDS:
        wanted = IdFilter(others, n)
        sure = row.mapInArrow(lean(_apart(wanted, False)), row.schema)
        rest = written(row.mapInArrow(lean(_apart(wanted, True)), row.schema), "apart")
    single = rest.join(ids.filter("rows = 1 AND names").select("kept"), F.col("row.doc_id") == F.col("kept"), "left_semi")
    out = sure.unionByName(single) if n <= MOST_IDS else single
    repeated = ids.filter("rows > 1 AND names").select("kept")
    several = repeated.count()
    if not several and named.filter("doc_id IS NULL").isEmpty():
        return out.select("row.*")
    schema = StructType([*(StructField(c, LongType()) for c in ("id", "s1", "s2", "n")), *row.schema])
    rows = written(rest.mapInArrow(lean(_printed(IdFilter(repeated, min(several, MOST_IDS)))), schema), "repeated")
    prints = named.filter("doc_id = class_id").join(repeated, F.col("doc_id") == F.col("kept"), "left_semi").select(F.col("doc_id").alias("id"), "s1", "s2").distinct()
    more = rows.join(prints, ["id", "s1", "s2"], "left_semi").unionByName(rows.filter("id IS NULL AND n > 0"))
    one = more.groupBy("id", "s1", "s2").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return out.unionByName(one.select("row")).unionByName(rows.filter("id IS NULL AND n = 0").select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
