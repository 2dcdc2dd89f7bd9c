"""Benchmark decontamination with one Aho-Corasick automaton over test questions and answers.

A text is read as words: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters.
A window is 13 consecutive words of a benchmark item; an item of fewer words, but not none, is one
window. The automaton's letters are the benchmark's distinct words; words the benchmark does not
have are one letter that no pattern contains. Its patterns are the short items whole, and the long
items' anchors: every seventh run of seven words, one of which lies wholly inside any window. Where
an anchor occurs, up to six words on either side are compared with the item, which gives exactly
the windows that occur. Word positions are mapped back to code-point offsets in the original text.

The automaton is arrays: transitions in one sorted column, failure and output links by node, at
most one node for each benchmark word. All texts of a batch are one sequence, scanned once, in many
lanes that step together; a lane starts eleven words early, which settles its state.

The driver builds the automaton and sends it to the workers, so its size is checked first: a
benchmark word takes about 30 bytes, and each distinct word some 150 more, so 100 MB of benchmark
is about 0.5 GB in a worker. Beyond ``BLOCK_BYTES`` the items are dealt into several automata, of
which a worker holds one at a time; the documents are still read once, and not written.

Defined cases: a null or empty text has no words and no hits; every row is judged by itself, so
repeated rows and equal ids are no matter; a null item id still hits words but is not listed;
repeated items count once; an empty benchmark hits nothing; other columns are ignored, whatever
their names (``contamination``) or kept as they are (``clean_documents``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm._common import keeps, lean, mapped, only, small_batches, table

#: Fixed values of the contamination rule.
WINDOW = 13
RATIO = 20
#: Words of an anchor, and how far a window reaches past one.
ANCHOR = (WINDOW + 1) // 2
REACH = WINDOW - ANCHOR
#: Benchmark text that one automaton is built over.
BLOCK_BYTES = 128 << 20
#: Words of a lane, and places that are compared at a time.
LANE, PAIRS = 256, 1 << 20

_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FOUND = "found struct<n_words: long, hits: array<struct<start: int, end: int>>, items: array<long>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first, first + 1, ... of ``count`` each: which range, and the number."""
    which = np.repeat(np.arange(len(first)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


class Windows:
    """The automaton of a block of items: (item_id, text)."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.letters: dict[bytes, int] = {}
        coded: list[int] = [0] * REACH
        starts, sizes, ids = [], [], []
        for item, text in items:
            own = [self.letters.setdefault(w, len(self.letters) + 1) for w in words(text)]
            if own:
                starts.append(len(coded))
                sizes.append(len(own))
                ids.append(item)
                coded += [*own, 0]
        #: Items' words, a zero after each item.
        self.text = np.array([*coded, *[0] * REACH], "i4")
        self.starts, sizes = np.array(starts, "i8"), np.array(sizes, "i8")
        self.ids = np.array([0 if i is None else i for i in ids], "i8")
        self.named = np.array([i is not None for i in ids], bool)
        long = sizes >= WINDOW
        which, turn = _spread(np.zeros(int(long.sum()), "i8"), sizes[long] // ANCHOR)
        self._build(
            np.concatenate((self.starts[~long], self.starts[long][which] + turn * ANCHOR)), np.concatenate((sizes[~long], np.full(len(which), ANCHOR))), int((~long).sum())
        )

    def _build(self, at: np.ndarray, size: np.ndarray, whole: int) -> None:
        """Occurrences of patterns start ``at``; the first ``whole`` are whole items."""
        node = np.zeros(len(at), "i8")
        keys, parents, nodes = [], [], 1
        for d in range(int(size.max()) if len(size) else 0):
            on = np.flatnonzero(size > d)
            level, child = np.unique(node[on] << 32 | self.text[at[on] + d], return_inverse=True)
            node[on] = child + nodes
            keys.append(level)
            nodes += len(level)
        #: Transition k is (parent << 32 | letter) and leads to node k + 1; levels follow each other, so all are in order.
        self.keys = np.concatenate(keys) if keys else np.zeros(0, "i8")
        self.root = np.zeros(len(self.letters) + 1, "i4")
        if keys:
            self.root[(keys[0] & 0xFFFFFFFF)] = np.arange(1, len(keys[0]) + 1)
        self.fail = np.zeros(nodes, "i4")
        #: The longest pattern that ends at a node, as the node of its end; 0 for none.
        self.ends = np.zeros(nodes, "i4")
        self.ends[node] = node
        first = 1
        for d, level in enumerate(keys):
            own = np.arange(first, first + len(level))
            if d:
                self.fail[own] = self._step(self.fail[level >> 32], (level & 0xFFFFFFFF).astype("i4"))
            self.ends[own] = np.where(self.ends[own] > 0, own, self.ends[self.fail[own]])
            first += len(level)
        # Occurrences by the node where they end.
        order = np.argsort(node, kind="stable")
        self.at, self.size, self.whole = at[order], size[order].astype("i1"), order < whole
        self.count = np.bincount(node, minlength=nodes).astype("i4")
        self.first = (np.cumsum(self.count) - self.count).astype("i8")

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out = self.root[letter]
        todo = np.flatnonzero((state > 0) & (letter > 0))
        state, letter = state[todo].astype("i8"), letter[todo]
        while len(todo):
            key = state << 32 | letter
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[todo[hit]] = at[hit] + 1
            # At the root the table has the answer already.
            state = self.fail[state]
            on = ~hit & (state > 0)
            todo, state, letter = todo[on], state[on].astype("i8"), letter[on]
        return out

    def _ends(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and nodes where a pattern of the automaton ends, from one pass over ``seq``."""
        before = WINDOW - 2
        lanes = ceil(len(seq) / LANE)
        padded = np.concatenate((np.zeros(before, "i4"), seq, np.zeros(lanes * LANE - len(seq), "i4")))
        state = np.zeros(lanes, "i4")
        places, nodes = [], []
        for k in range(-before, LANE):
            state = self._step(state, padded[k + before :: LANE][:lanes])
            if k >= 0:
                hit = np.flatnonzero(self.ends[state])
                places.append(hit * LANE + k)
                nodes.append(self.ends[state[hit]])
        place, node = np.concatenate(places), np.concatenate(nodes)
        all_places, all_nodes = [place], [node]
        while len(node):
            node = self.ends[self.fail[node]]
            place, node = place[node > 0], node[node > 0]
            all_places.append(place)
            all_nodes.append(node)
        return np.concatenate(all_places), np.concatenate(all_nodes)

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Per text: number of words, runs of hit words (rows of start, end), items in order."""
        codes: list[int] = []
        counts = np.zeros(len(texts), "i8")
        for k, text in enumerate(texts):
            found = words(text)
            counts[k] = len(found)
            codes.extend(map(self.letters.get, found, repeat(0)))
            codes.append(0)
        begins = np.cumsum(counts + 1) - counts - 1
        seq = np.array(codes, "i4")
        cover = np.zeros(len(seq) + 1, "i8")
        owned: list[np.ndarray] = []
        if len(self.keys) and len(seq):
            place, node = self._ends(seq)
            padded = np.concatenate((np.zeros(REACH, "i4"), seq, np.zeros(REACH, "i4")))
            ends = np.cumsum(self.count[node].astype("i8"))
            k = 0
            while k < len(node):
                after = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, side="right")))
                which, occurrence = _spread(self.first[node[k:after]], self.count[node[k:after]])
                self._settle(padded, place[k:after][which], occurrence, cover, owned, begins)
                k = after
        covered = np.cumsum(cover[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype("i1"))).reshape(-1, 2)
        inside = np.searchsorted(begins, edges[:, 0], side="right") - 1
        cuts = np.searchsorted(inside, np.arange(len(texts) + 1))
        edges = edges - begins[inside][:, None]
        pairs = np.unique(np.concatenate(owned), axis=0) if owned else np.zeros((0, 2), "i8")
        item_cuts = np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
        return counts, [edges[a:b] for a, b in zip(cuts, cuts[1:])], [pairs[a:b, 1] for a, b in zip(item_cuts, item_cuts[1:])]

    def _settle(self, padded: np.ndarray, last: np.ndarray, occurrence: np.ndarray, cover: np.ndarray, owned: list[np.ndarray], begins: np.ndarray) -> None:
        """Which windows are at ``last``, the place where an occurrence's pattern ends in the texts."""
        at, size, whole = self.at[occurrence], self.size[occurrence].astype("i8"), self.whole[occurrence]
        left, right = np.zeros(len(at), "i8"), np.zeros(len(at), "i8")
        for reach, step, here, there in ((left, -1, last - size + 1, at), (right, 1, last, at + size - 1)):
            on = np.flatnonzero(~whole)
            for k in range(1, REACH + 1):
                mine = padded[here[on] + step * k + REACH]
                on = on[(mine > 0) & (mine == self.text[there[on] + step * k])]
                reach[on] += 1
        hit = whole | (left + right + size >= WINDOW)
        start, end = (last - size + 1 - left)[hit], (last + 1 + right)[hit]
        np.add.at(cover, start, 1)
        np.add.at(cover, end, -1)
        item = np.searchsorted(self.starts, at[hit], side="right") - 1
        named = self.named[item]
        text = np.searchsorted(begins, start[named], side="right") - 1
        owned.append(np.unique(np.stack([text, self.ids[item[named]]], 1), axis=0))


_built: dict[int, Windows] = {}


class _Block:
    """A broadcast automaton with a key that a worker can remember it by."""

    def __init__(self, spark: SparkSession, windows: Windows):
        self.sent = spark.sparkContext.broadcast(windows)
        self.id = self.sent._jbroadcast.id() if self.sent._jbroadcast is not None else id(self)

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    def windows(self) -> Windows:
        """One automaton at a time in a worker."""
        if self.id not in _built:
            _built.clear()
            keeps("decontaminate", _built.clear)
            _built[self.id] = self.sent.value
            self.sent.__dict__.pop("_value", None)
        return _built[self.id]


def _joined(runs: np.ndarray) -> np.ndarray:
    """Overlapping and touching runs (rows of start, end) as one."""
    if len(runs) < 2:
        return runs
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate(([True], runs[1:, 0] > reach[:-1]))
    return np.stack([runs[new, 0], reach[np.concatenate((new[1:], [True]))]], 1)


def _list(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([0], np.cumsum([len(c) for c in cells]))).astype("i4"), np.concatenate(cells)


def _scan(blocks: list[_Block], text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("decontaminate")
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(text_at).to_pylist()
            counts, runs, items = blocks[0].windows().scan(texts)
            for block in blocks[1:]:
                _, more, others = block.windows().scan(texts)
                runs = [_joined(np.concatenate(c)) for c in zip(runs, more, strict=True)]
                items = [np.unique(np.concatenate(c)) for c in zip(items, others, strict=True)]
            ends, spans = _list(runs)
            span = pa.StructArray.from_arrays([pa.array(spans[:, k].astype("i4")) for k in (0, 1)], ["start", "end"])
            item_ends, owned = _list(items)
            lists = [pa.ListArray.from_arrays(pa.array(ends), span), pa.ListArray.from_arrays(pa.array(item_ends), pa.array(owned.astype("i8")))]
            found = pa.StructArray.from_arrays([pa.array(counts), *lists], ["n_words", "hits", "items"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "found"])

    return run


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The items (item_id, text) in blocks of about ``block_bytes`` of text at most, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, ceil(total / block_bytes * (1.25 if total > block_bytes else 1)))
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in dealt.filter(F.col("_block") == k).select("item_id", "text").distinct().collect()]


def scanned(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., and a struct ``found``: n_words, hits (runs of hit words), items."""
    small_batches(docs.sparkSession)
    sent = [_Block(docs.sparkSession, Windows(items)) for items in blocks(benchmark, block_bytes)]
    return mapped(docs, _scan(sent, docs.columns.index("text")), StructType.fromDDL(FOUND))


def _hit() -> F.Column:
    return F.aggregate("found.hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])


def contaminated(n_hit: F.Column, n_words: F.Column) -> F.Column:
    return (n_hit > 0) & (RATIO * n_hit >= n_words)


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for text, hits in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            at = np.array([m.span() for m in _WORD.finditer(text.as_py() or "")], dtype="i8").reshape(-1, 2) if hits else None
            spans.append([{"start": int(at[h["start"], 0]), "end": int(at[h["end"] - 1, 1])} for h in hits])
        span = pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, spans: code-point ranges of the original text that windows cover, documents with any."""
    found = scanned(docs.select("doc_id", "text"), benchmark).filter(F.size("found.hits") > 0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("c0", "c1", "found.hits").mapInArrow(lean(_offsets), f"doc_id {kind}, spans array<struct<start:bigint,end:bigint>>")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of ``docs``."""
    named = F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ",")
    return scanned(docs.select("doc_id", "text"), benchmark).select(
        F.col("c0").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        _hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"),
        contaminated(_hit(), F.col("found.n_words")).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns as they were."""
    found = scanned(docs, benchmark)
    return found.filter(~contaminated(_hit(), F.col("found.n_words"))).drop("found").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def expected(rows: list[tuple], items: list[tuple], size: int = WINDOW) -> list[tuple]:
    """Brute force over a small fixture: (doc_id, text) and (item_id, text)."""
    read = lambda t: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in _WORD.findall(t or "")]
    windows = {(tuple(read(t)[k : k + size]), i) for i, t in items for k in range(max(1, len(read(t)) - size + 1)) if read(t)}
    out = []
    for doc, text in rows:
        have = read(text)
        hit, own = set(), set()
        for w, i in windows:
            for k in range(len(have) - len(w) + 1):
                if tuple(have[k : k + len(w)]) == w:
                    hit.update(range(k, k + len(w)))
                    own.add(i)
        names = ",".join(sorted(str(i) for i in own if i is not None))
        out.append((doc, len(have), len(hit), len(own - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and RATIO * len(hit) >= len(have)))
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[k : k + least(len(ws), 13) - 1], ' ') AS w
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS k) WHERE len(ws) > 0
), lens AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS w
  FROM d, lens, LATERAL (SELECT unnest(generate_series(1, len(ws) - n + 1)) AS k)
), hits AS (
  SELECT dw.doc_id, dw.k, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w
), marked AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS j FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
