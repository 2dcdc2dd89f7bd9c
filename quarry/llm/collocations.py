"""Phrase collocations: vertical positional inverted lists, extended word by word.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those into words at
blanks and tabs. All counts are per lang. The words of some documents of one lang are a block of
about ``BLOCK`` words: its word list, and at each position the number of its word, 0 between pieces.

1. The lengths of the blocks' word lists are added up; words that occur ``LEAST`` times are frequent.
2. In each block the positions of frequent phrases of k - 1 words are merge-joined with the postings
   of the adjacent word, those where it starts a frequent phrase of k - 1 words itself (for k = 2,
   a frequent word): what comes out is the occurrence list of each phrase of k words, and its length
   is the phrase's exact frequency in the block. Each block sends the lengths to buckets by a hash of
   the phrase, packed; there they are added up, and blocks are told which phrases are frequent. This
   for k = 2, 3, 4.
3. A phrase is known by the two phrases that it was joined from, so the frequencies of all its first
   and last words come along with these, and containment needs only its prefix and suffix: what a
   phrase of four words contains, one of three with no smaller frequency does.

A phrase that fills a third of the corpus is one entry for each block. Nothing but the number of rows
of a fixed-size window per lang is limited: the report's first ``TOP``, taken in two steps.

Scores are exact: products are decimals.

Defined cases: a null text is empty; a null lang is ``und``, as is the lang of that name; empty
pieces have no words; repeated rows each count; a very long text, or a piece longer than a block, is
cut between blocks without loss (a block also sees the three words after its own); an empty table
gives an empty result; other columns are ignored, whatever their names. Doc_id is not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm._common import input_bytes, lean, only, parts, small_batches, table, written, written_once
from quarry.llm.shingles import mixed

UNKNOWN = "und"
LEAST, LONGEST, TOP = 30, 4, 2000
#: Share of a phrase's occurrences that lie inside a longer one, in hundredths, from which it is dropped.
INSIDE = 80
#: Words of a block, words held by a task in all, bytes of text split at a time.
BLOCK, HELD, CHUNK = 1 << 20, 4 << 20, 2 << 20
#: Bytes of input for each bucket of phrases.
BUCKET_BYTES = 8 << 20
#: Bits of a phrase's number in its block, and of a block's in its task.
IN_BLOCK, IN_TASK = 22, 20
#: A lang's phrases are ranked in so many parts first.
SALTS = 256

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(46 if b in _SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b < 91 else b for b in range(256))


class _Numbers(dict):
    """Words by first appearance, from 1; the separator is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _numbers() -> _Numbers:
    return _Numbers({b".": 0})


def words_of(text: str) -> Iterator[list[bytes]]:
    """Words, and ``.`` between pieces, of a text that counts as followed by a separator; chunk by chunk."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE) + b"."
    a = 0
    while a < len(data):
        b = a + CHUNK
        if b < len(data):
            b = 1 + max(data.rfind(b" ", a, b), data.rfind(b".", a, b))
            if b == 0:
                ends = [k for k in (data.find(b" ", a + CHUNK), data.find(b".", a + CHUNK)) if k >= 0]
                b = 1 + min(ends)
        yield data[a:b].replace(b".", b" . ").split()
        a = b


class _Block:
    """The words of one lang that a task has gathered."""

    def __init__(self) -> None:
        self.numbers = _numbers()
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        got = np.fromiter(map(self.numbers.__getitem__, words), "i4", len(words))
        got = got[np.concatenate(([True], (got[1:] != 0) | (got[:-1] != 0)))] if len(got) else got
        self.held.append(got)
        self.size += len(got)

    def take(self, all_of_it: bool) -> tuple[np.ndarray, int, list[str], np.ndarray] | None:
        """Word numbers, how many of them are the block's own, its words and their own occurrences; the rest stays for the next block."""
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "i4")
        if not len(ids):
            return None
        own = seen = len(ids)
        if not all_of_it:
            gaps = np.flatnonzero(ids == 0)
            if len(gaps):
                own = seen = int(gaps[-1]) + 1
            elif len(ids) < 2 * BLOCK:
                return None
            else:
                own = len(ids) - (LONGEST - 1)  # one piece longer than blocks: those that follow are seen, not counted
        names = list(self.numbers)
        rest = [names[k] for k in ids[own:]]
        counts = np.bincount(ids[:own], minlength=len(names))[1:]
        out = ids[:seen], own, [w.decode("utf-8", "surrogatepass") for w in names[1:]], counts
        self.__init__()
        if rest:
            self.add(rest)
        return out


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed planes of bytes."""
    return pa.compress(b"".join(np.ascontiguousarray(a).view("u1").reshape(len(a), -1).T.tobytes() for a in arrays), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(data, n * sum(widths), codec="zstd"), "u1")
    out, at = [], 0
    for t, w in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t).ravel())
        at += n * w
    return out


BLOCKS = "block long, lang string, own int, seen int, ids binary, words array<string>, counts array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("collocations")
    held: dict[str, _Block] = {}
    task = TaskContext.get()
    first, made = (task.partitionId() if task else 0) << IN_TASK, 0

    def give(lang: str, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        nonlocal made
        got = held[lang].take(all_of_it)
        if got is not None and len(got[2]):
            ids, own, words, counts = got
            columns = [[first + made], [lang], [own], [len(ids)], [packed(ids)], [words], [counts]]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            block = held.setdefault(lang, _Block())
            for words in words_of(text.as_py() or ""):
                block.add(words)
                if block.size >= BLOCK:
                    yield from give(lang, False)
        if sum(b.size for b in held.values()) > HELD:
            for lang in list(held):
                yield from give(lang, True)
            held.clear()
    for lang in list(held):
        yield from give(lang, True)


def joined(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two rising lists of positions: where a position of ``left`` is followed by one of ``right``, as indices into both."""
    at = np.searchsorted(right, left + 1)
    at[at == len(right)] = 0
    hit = np.flatnonzero(right[at] == left + 1) if len(right) else np.zeros(0, "i8")
    return hit, at[hit]


def occurrences(positions: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases one word longer: position of each occurrence, its phrase's number from 0, and each phrase's first and last part.

    ``positions`` rise; ``phrase`` is the number, from 0, of the shorter phrase that starts at each.
    """
    first, second = joined(positions, positions)
    wide = np.int64(phrase.max() + 1 if len(phrase) else 1)
    pair, number = np.unique(phrase[first].astype("i8") * wide + phrase[second], return_inverse=True)
    return positions[first], number, pair // wide, pair % wide


#: From a block to a bucket: ``size`` phrases, packed: number in the block less the one before, prefix, suffix, occurrences.
SENT = "bucket int, block long, size int, phrases binary"
_SENT = ("u4", "i8", "i8", "u4")


def _extended(k: int, buckets: int):
    """The phrases of ``k`` words of a block, given what is frequent among the shorter ones."""

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in SENT.split(", ")]
        rows: list[tuple] = []
        if block.num_rows and told.num_rows:
            one = block.to_pylist()[0]
            (ids,) = unpacked(one["ids"], one["seen"], "i4")
            known = _known(told, k)
            positions, phrase = np.arange(len(ids)), ids.astype("i8")
            prefix = suffix = np.zeros(0, "i8")
            for size in range(1, k):
                # Of the phrases of this many words, the lists of the frequent ones stay.
                frequent = np.zeros(max(int(phrase.max(initial=0)), int(known[size][0].max(initial=0))) + 1, "i8")
                frequent[known[size][0]] = known[size][1]
                kept = frequent[phrase] > 0
                positions, longer, first, second = occurrences(positions[kept], phrase[kept])
                phrase, prefix, suffix = longer + 1, frequent[first], frequent[second]
            n = np.bincount(phrase[positions < one["own"]] - 1, minlength=len(prefix)).astype("u4")
            bucket = (mixed(prefix.astype("u8") * np.uint64(0x9E3779B97F4A7C15) + suffix.astype("u8")) % np.uint64(buckets)).astype("i4")
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(own):
                    rows.append((int(bucket[own[0]]), one["block"], len(own), packed(np.diff(own + 1, prepend=0).astype("u4"), prefix[own], suffix[own], n[own])))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

    return run


#: What blocks are told, either a phrase or, packed, ``size`` phrases: number in the block less the one before, id.
TOLD = "block long, level int, number long, id long, size int, phrases binary"
_TOLD = ("u4", "i8")


def _known(told: pa.Table, k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers in the block and ids of its frequent phrases of 1 to k - 1 words."""
    got: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {size: [] for size in range(1, k)}
    single = told.filter(told.column("phrases").is_null())
    if single.num_rows:
        got[1].append((single.column("number").to_numpy() & ((1 << IN_BLOCK) - 1), single.column("id").to_numpy()))
    for row in told.filter(told.column("phrases").is_valid()).select(["level", "size", "phrases"]).to_pylist():
        step, ids = unpacked(row["phrases"], row["size"], *_TOLD)
        got[row["level"]].append((np.cumsum(step.astype("i8")), ids))
    none = (np.zeros(0, "i8"), np.zeros(0, "i8"))
    return {size: tuple(np.concatenate(c) for c in zip(none, *v, strict=True)) for size, v in got.items()}


#: From a bucket: what blocks are told, and each frequent phrase once.
FOUND = "block long, size int, phrases binary, id long, prefix long, suffix long, a long"


def _added_up(least: int):
    """A bucket's phrases: lengths added up, the frequent ones told to the blocks that have them. A phrase's id is the least of its numbers."""

    def run(sent: pa.Table) -> pa.Table:
        held, blocks = [], []
        for row in sent.select(["block", "size", "phrases"]).to_pylist():
            step, prefix, suffix, n = unpacked(row["phrases"], row["size"], *_SENT)
            held.append((np.cumsum(step.astype("i8")), prefix, suffix, n.astype("i8")))
            blocks.append(np.full(row["size"], row["block"]))
        number, prefix, suffix, n = (np.concatenate(c) for c in zip(*held, strict=True))
        block = np.concatenate(blocks)
        order = np.lexsort((number, block, suffix, prefix))
        number, prefix, suffix, n, block = (x[order] for x in (number, prefix, suffix, n, block))
        new = np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])))
        starts = np.flatnonzero(new)
        a = np.add.reduceat(n, starts)
        ids = (block[starts] << IN_BLOCK) + number[starts]
        which = np.cumsum(new) - 1
        tell = np.flatnonzero(a[which] >= least)
        tell = tell[np.lexsort((number[tell], block[tell]))]
        rows = []
        for own in np.split(tell, np.flatnonzero(np.diff(block[tell])) + 1):
            if len(own):
                rows.append((int(block[own[0]]), len(own), packed(np.diff(number[own], prepend=0).astype("u4"), ids[which[own]])))
        some = a >= least
        told = pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["block", "size", "phrases"])
        once = pa.Table.from_arrays([pa.array(v[some]) for v in (ids, prefix[starts], suffix[starts], a)], ["id", "prefix", "suffix", "a"])
        return pa.concat_tables([told, once], promote_options="default")

    return run


def _frequent_words(blocks: DataFrame) -> DataFrame:
    """number, id, and for one row of each word that occurs ``LEAST`` times in its lang (number = id) lang, word, a.

    A window, so that the blocks' rows move once: a word has one for each block.
    """
    rows = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w"))
    rows = rows.select((F.shiftleft("block", IN_BLOCK) + F.col("k") + 1).alias("number"), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    same = Window.partitionBy("lang", "word")
    rows = rows.withColumns({"a": F.sum("n").over(same), "id": F.min("number").over(same)}).filter(F.col("a") >= LEAST)
    once = lambda c: F.when(F.col("number") == F.col("id"), F.col(c)).alias(c)
    return rows.select("number", "id", once("lang"), once("word"), once("a"))


def phrases(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """lang, n; and for 1 to ``LONGEST`` words the frequent phrases: id, lang, phrase, a, last (word), firsts and lasts
    (frequencies of its first and last 1, 2, ... words), prefix and suffix (ids of its parts)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    blocks = written(rows.mapInArrow(lean(_blocks), BLOCKS), "phrase-blocks")
    sizes = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, v: a + v)).alias("n"))
    found = written_once(_frequent_words(blocks), "phrase-words")
    a = F.array("a")
    first = found.filter("number = id").select("id", "lang", F.col("word").alias("phrase"), "a", F.col("word").alias("last"), a.alias("firsts"), a.alias("lasts"))
    levels = [first.withColumns({c: F.lit(None).cast("long") for c in ("prefix", "suffix")})]
    none = {"size": F.lit(None).cast("int"), "phrases": F.lit(None).cast("binary")}
    told = found.select(F.shiftright("number", IN_BLOCK).alias("block"), F.lit(1).alias("level"), "number", "id").withColumns(none)
    base = blocks.select("block", "own", "seen", "ids")
    buckets = max(parts(spark), ceil(input_bytes(docs) / BUCKET_BYTES))
    for k in range(2, LONGEST + 1):
        sent = base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_extended(k, buckets), SENT)
        found = written_once(sent.groupBy("bucket").applyInArrow(_added_up(LEAST), FOUND), f"phrases-{k}")
        nothing = {c: F.lit(None).cast("long") for c in ("number", "id")}
        told = told.unionByName(found.filter("phrases IS NOT NULL").select("block", F.lit(k).alias("level"), "size", "phrases").withColumns(nothing))
        shorter = levels[-1]
        x = shorter.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("begin"), "firsts")
        y = shorter.select(F.col("id").alias("suffix"), "last", "lasts")
        named = found.filter("id IS NOT NULL").select("id", "prefix", "suffix", "a").join(x, "prefix").join(y, "suffix")
        levels.append(
            written(
                named.select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "a", "last", F.concat("firsts", a).alias("firsts"), F.concat("lasts", a).alias("lasts"), "prefix", "suffix"),
                f"phrases-named-{k}",
            )
        )
    return sizes, levels


def _cut(k: int) -> Column:
    """The lowest-scoring cut, of equals the first: score, at, l, r."""
    whole = "CAST({} AS DECIMAL(20, 0))"
    score = f"2000000BD * {whole.format('a')} DIV ({whole.format('firsts[j - 1]')} + {whole.format(f'lasts[{k} - j - 1]')})"
    return F.expr(f"array_min(transform(sequence(1, {k - 1}), j -> named_struct('score', {score}, 'at', j, 'l', firsts[j - 1], 'r', lasts[{k} - j - 1])))")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first ``top`` phrases."""
    sizes, levels = phrases(docs)
    kept = []
    for k in range(2, LONGEST + 1):
        rows = levels[k - 1].withColumn("cut", _cut(k))
        if k < LONGEST:
            parts = levels[k].select(F.explode(F.array("prefix", "suffix")).alias("id"), F.col("a").alias("longer"))
            rows = rows.join(parts.groupBy("id").agg(F.max("longer").alias("longer")), "id", "left")
            inside = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * INSIDE
            rows = rows.filter(~F.coalesce(inside, F.lit(False)))
        kept.append(rows.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    every = kept[0].unionByName(kept[1]).unionByName(kept[2])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = every.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, generate_subscripts(ws, 1) AS i FROM listed),
every AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, ws[i : i + k - 1] AS words
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)
),
f AS (SELECT lang, k, phrase, any_value(words) AS words, count(*) AS f FROM every GROUP BY lang, k, phrase),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, words, f AS a FROM f WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = array_to_string(c.words[1 : c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.phrase = array_to_string(c.words[c.cut + 1 : c.k], ' ')
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (
  SELECT lang, a AS longer, array_to_string(words[i : i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM candidates), (SELECT unnest([2, 3]) AS m) WHERE m < k AND i + m - 1 <= k
),
inside AS (SELECT lang, phrase, max(longer) AS longer FROM parts GROUP BY lang, phrase),
kept AS (
  SELECT w.* FROM lowest w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE NOT coalesce(100::HUGEINT * i.longer >= 80::HUGEINT * w.a, false)
)
SELECT k.lang, (row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept k JOIN sizes s ON s.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
