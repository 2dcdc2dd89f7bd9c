"""Language identification by partial matching: byte context trees with escapes, frozen after training.

Bytes become symbols: A-Z as a-z, every other ASCII byte that is no letter as one blank, bytes above
127 as they are. Each language has a tree of contexts of up to ``ORDER`` symbols with counts of what
follows. A symbol s after a history costs, in bits, the escapes from the longest context of the
history that the tree knows down to the longest one in which s is known, and -log2 of its share
there: with N occurrences of a context, d symbols kept in it and n of s, the share is n / (N + d) and
the escape (N - sum of n + d) / (N + d); below the empty context all symbols are equal. Statistics do
not change while scoring, and there is no exclusion, so each cost depends on the history's longest
known context and the symbol alone. A text's code length is the sum over its bytes; the language with
the shortest code, -log2 of its share of training texts included, is the prediction, ties to the
language that sorts first. The score is the best language's share of 2^-length.

Trees of all languages are one automaton over symbols, whose states are the known strings of up to
``ORDER`` + 1 symbols; a state carries for each language what entering it costs. So scoring makes one
step for each byte whatever the order, and many stretches of the texts step together; a stretch
starts ``ORDER`` + 1 symbols early, which is as far as a state looks back.

The sample: about ``SAMPLE_BYTES`` of whole training texts for each language, chosen by a hash of id
and text (a language with fewer gives all). Counting runs on Spark and only strings that occur
``LEAST`` times and are among the language's commonest come to the driver: their number is bounded so
that the automaton is at most ``CELLS`` numbers, whatever the corpus.

Defined cases: a null text, and one without any letter, is ``und`` with score 0; so is every text if
nothing could be learned. Rows with a null lang teach nothing, those with a null doc_id are not held
out. Repeated rows each count. An empty table gives an empty result. Other columns are ignored,
whatever their names; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm._common import lean, only, parts, small_batches, table, written
from quarry.llm.quality import held_out

UNKNOWN = "und"
ORDER = 4
SAMPLE_BYTES = 2 << 20
LEAST = 4
#: Numbers in the automaton's transitions (32 MB), and in each of its two tables of costs (64 MB) if there are many languages.
CELLS = 1 << 23
#: Bytes scored at a time, and the width of the matrix that steps together.
SLICE, COLUMNS = 2 << 20, 512

BLANK, BREAK = 1, 0
#: Symbol of each byte; 0 stands between texts.
SYMBOLS = np.array([BLANK if b < 128 and not chr(b).isalpha() else b + 32 if 65 <= b < 91 else b for b in range(256)], "u1")


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, a break before each, and where each text's break is."""
    lengths = np.array([len(t) + 1 for t in texts], "i8")
    out = SYMBOLS[np.frombuffer(b"\0" + b"\0".join(texts), "u1")]
    starts = np.cumsum(lengths) - lengths
    out[starts] = BREAK
    return out, starts


def strings(data: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all strings of 1 to ``longest`` symbols that hold no break.

    A key has eight bits for each symbol, the last symbol lowest; as no symbol is 0, its length shows.
    """
    keys, counts = [], []
    value = np.zeros(len(data), "u8")
    whole = np.ones(len(data), bool)
    for k in range(longest):
        shifted = data[: len(data) - k]
        value[k:] |= shifted.astype("u8") << np.uint64(8 * k)
        whole[k:] &= shifted != BREAK
        whole[:k] = False
        own, n = np.unique(value[whole], return_counts=True)
        keys.append(own)
        counts.append(n)
    return np.concatenate(keys), np.concatenate(counts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, key, n of (lang, text) batches."""
    only("language_id")
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, texts in ((k, v[a : a + 64]) for k, v in held.items() for a in range(0, len(v), 64)):
            keys, n = strings(symbols(texts)[0], ORDER + 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view("i8")), pa.array(n.astype("i8"))], ["lang", "key", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            held.setdefault(lang.as_py(), []).extend(data[k : k + SLICE] for k in range(0, len(data), SLICE))
            size += len(data)
        if size > SLICE:
            yield from flush()
            size = 0
    yield from flush()


def learnable(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text of the rows that may be learned from."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")


def sampled(rows: DataFrame, sizes: dict[str, int], most: int = SAMPLE_BYTES) -> DataFrame:
    """lang, text: about ``most`` bytes of each language, whole texts by hash. ``sizes``: the bytes that there are."""
    share = F.create_map(*(F.lit(v) for lang, size in sizes.items() for v in (lang, min(1.0, most / max(size, 1)))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(place < share[F.col("lang")]).select("lang", "text")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Bits of each language's prior.
    prior: np.ndarray
    #: Class of each symbol, and the next state by state and class.
    classes: np.ndarray
    step: np.ndarray
    #: By language and state: bits that entering the state costs, and bits of escapes that it has ahead.
    cost: np.ndarray
    ahead: np.ndarray

    @property
    def start(self) -> int:
        return len(self.step) - 1


def trained(counts: dict[str, dict[int, int]], prior: dict[str, int]) -> Model | None:
    """The automaton from each language's kept strings (key to count), which hold all their parts too, and its training texts."""
    languages = tuple(sorted(k for k, v in counts.items() if v))
    if not languages:
        return None
    every = np.array(sorted({k for lang in languages for k in counts[lang]}), "u8")
    length = sum((every >> np.uint64(8 * k) > 0).astype("i8") for k in range(8))
    order = np.lexsort((every, length))
    every, length = every[order], length[order]
    # State 0 is the empty string, 1 and on are the strings by length, the last stands after a break.
    at = {int(k): i + 1 for i, k in enumerate(every)}
    n = len(every) + 1
    low = lambda size: np.where(size > 0, (np.uint64(1) << (np.uint64(8) * size.astype("u8"))) - np.uint64(1), np.uint64(0))
    find = lambda keys: np.array([at.get(int(k), 0) for k in keys], "i8")
    parent = np.concatenate(([0], find(every >> np.uint64(8))))
    suffix = np.concatenate(([0], find(every & low(length - 1))))
    length = np.concatenate(([0], length))
    last = np.concatenate(([0], (every & np.uint64(255)).astype("i8")))
    seen = np.unique(last[1:])
    classes = np.zeros(256, "u1")
    classes[seen] = np.arange(2, len(seen) + 2)
    classes[np.setdiff1d(np.arange(1, 256), seen)] = 1  # never seen
    width = len(seen) + 2
    step = np.zeros((n + 1, width), "i4")
    levels = [np.flatnonzero(length == k) for k in range(ORDER + 2)]
    for k, level in enumerate(levels):
        if k:
            step[level] = step[suffix[level]]
        children = levels[k + 1] if k + 1 < len(levels) else np.zeros(0, "i8")
        step[parent[children], classes[last[children]]] = children
    step[:, 0] = n
    step[n] = step[0]
    count = np.zeros((len(languages), n))
    for row, lang in enumerate(languages):
        own = counts[lang]
        count[row, find(np.fromiter(own, "u8", len(own)))] = np.fromiter(own.values(), "f8", len(own))
        count[row, 0] = count[row, levels[1]].sum()
    kept, kinds = np.zeros_like(count), np.zeros_like(count)
    for row in range(len(languages)):
        np.add.at(kept[row], parent[1:], count[row, 1:])
        np.add.at(kinds[row], parent[1:], count[row, 1:] > 0)
    total = np.maximum(count, kept)
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(count > 0, -np.log2(np.where(kinds > 0, (total - kept + kinds) / (total + kinds), 1.0)), 0.0)
        bits = np.where(count > 0, -np.log2(count / (total + kinds)[:, parent]), 0.0)
    down = np.zeros_like(count)  # escapes from a context's longest known one to below the empty one
    down[:, 0] = escape[:, 0]
    cost = np.zeros_like(count)
    cost[:, 0] = np.log2(len(seen) + 1)
    for level in levels[1:]:
        known = count[:, level] > 0
        inner = known & (length[level] <= ORDER)
        down[:, level] = down[:, suffix[level]] + np.where(inner, escape[:, level], 0.0)
        cost[:, level] = np.where(known, bits[:, level] - down[:, parent[level]], cost[:, suffix[level]])
    ahead = np.column_stack([down, down[:, 0]])
    cost = np.column_stack([cost + down, down[:, 0]])  # after a break only what lies ahead counts
    texts = np.array([prior.get(lang, 0) for lang in languages], "f8") + 1
    return Model(languages, -np.log2(texts / texts.sum()), classes, step, cost, ahead)


def walk(model: Model, data: np.ndarray) -> np.ndarray:
    """The state after each symbol; the first must be a break."""
    back = ORDER + 1
    width = min(COLUMNS, len(data))
    rows = -(-len(data) // width)
    padded = np.zeros(back + rows * width, "u1")
    padded[back : back + len(data)] = model.classes[data]
    lanes = np.lib.stride_tricks.sliding_window_view(padded, back + width)[::width]
    lanes = np.ascontiguousarray(lanes.T)
    flat, kinds = model.step.ravel(), model.step.shape[1]
    out = np.empty((width, rows), "i4")
    state = np.full(rows, model.start, "i8")
    for k in range(back + width):
        state = flat[state * kinds + lanes[k]].astype("i8")
        if k >= back:
            out[k - back] = state
    return out.T.ravel()[: len(data)]


def lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text's code in each language, the prior included: texts x languages."""
    data, starts = symbols(texts)
    states = walk(model, data)
    ends = states[np.concatenate((starts[1:], [len(data)])) - 1]
    out = np.empty((len(texts), len(model.languages)))
    for k in range(len(model.languages)):
        out[:, k] = np.add.reduceat(model.cost[k][states], starts) - model.ahead[k][ends] + model.prior[k]
    return out


def long_length(model: Model, text: bytes) -> np.ndarray:
    """``lengths`` of one text of any size: slices, each after the symbols that its first states look back on."""
    total = np.array(model.prior)
    for k in range(0, max(len(text), 1), SLICE):
        before = text[max(0, k - ORDER - 1) : k]
        both = lengths(model, [before + text[k : k + SLICE], before])
        total += both[0] - both[1]
    return total


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language_id")
        for batch in batches:
            found: list[str] = [UNKNOWN] * batch.num_rows
            scores = [0.0] * batch.num_rows
            held: list[tuple[int, bytes]] = []
            size = 0

            def settle(rows: list[int], bits: np.ndarray, found=found, scores=scores) -> None:
                best = bits.argmin(1)
                share = 1 / np.exp2(np.minimum(0, bits.min(1)[:, None] - bits)).sum(1)
                for row, b, s in zip(rows, best, share, strict=True):
                    found[row], scores[row] = model.languages[b], float(s)

            for row, cell in enumerate(batch.column(1)):
                text = cell.as_py()
                if model is None or text is None or not any(map(str.isalpha, text)):
                    continue
                data = text.encode("utf-8", "surrogatepass")
                if len(data) > SLICE:
                    settle([row], long_length(model, data)[None])
                    continue
                held.append((row, data))
                size += len(data)
                if size > SLICE:
                    settle([r for r, _ in held], lengths(model, [t for _, t in held]))
                    held, size = [], 0
            if held:
                settle([r for r, _ in held], lengths(model, [t for _, t in held]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def fit(docs: DataFrame, most: int = SAMPLE_BYTES) -> Model | None:
    """Learned from lang and text of the rows that are not held out."""
    small_batches(docs.sparkSession)
    n = parts(docs.sparkSession)
    rows = learnable(docs)
    there = rows.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not there:
        return None
    texts = {r["lang"]: r["texts"] for r in there}
    sample = sampled(rows, {r["lang"]: r["bytes"] for r in there}, most)
    counted = sample.repartition(n).mapInArrow(lean(_count), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    counted = written(counted, "language-strings")
    # So many strings of each language that transitions (states x symbols) and costs (states x languages) keep to CELLS.
    each = max(1, CELLS // max(160, len(texts)) // len(texts))
    by_count = counted.groupBy("lang", "n").agg(F.count("*").alias("strings"))
    over = by_count.withColumn("upto", F.sum("strings").over(Window.partitionBy("lang").orderBy(F.desc("n")))).filter(F.col("upto") <= each)
    least = over.groupBy("lang").agg(F.min("n").alias("least"))
    counts: dict[str, dict[int, int]] = {}
    for r in counted.join(least, "lang").filter("n >= least").select("lang", "key", "n").toLocalIterator():
        counts.setdefault(r["lang"], {})[r["key"]] = r["n"]
    return trained({k: _closed(v) for k, v in counts.items()}, texts)


def _closed(kept: dict[int, int]) -> dict[int, int]:
    """Strings whose beginning and end, one symbol shorter, are kept too: a string at the edge of a text may lack one."""
    out: dict[int, int] = {}
    for key in sorted(kept):  # by length, as keys are
        size = (key.bit_length() + 7) // 8
        if size == 1 or (key >> 8 in out and key & (1 << 8 * (size - 1)) - 1 in out):
            out[key] = kept[key]
    return out


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_predict(model)), f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
