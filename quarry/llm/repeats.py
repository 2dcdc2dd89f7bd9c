"""Removal of repeated byte strings across documents, by hash-cut phrases and suffix order: prefix-free parsing in part.

A rolling hash of 19 bytes is taken at every place. A 50-byte window's trigger is the least hash
in it; a phrase is a longest run of windows with one trigger, so phrases overlap by 49 bytes, each
window belongs to exactly one, and equal windows always lie in phrases of the same trigger. The
phrases that occur are the dictionary, and the sequence of phrases is the parse.

1. Every part of the corpus is parsed, and its dictionary goes to buckets by trigger: each phrase
   once per part, by its hash, with the least document that has it.
2. In a bucket, a trigger that one document alone has is done with. Where all phrases of a trigger
   are the same, its windows repeat from the least document on. The others, whose phrases differ
   but may share windows, are asked for from the part with that least document.
3. The dictionary phrases asked for meet in their trigger's bucket. Their windows are put into
   suffix order as far as 50 bytes, which is as far as this needs; each run of equal ones takes
   the least document of the phrases it lies in.
4. What was found goes back to the parts, which look up their parse and cut the bytes out.

A trigger that has more than ``HOT`` phrases in one part, such as a string that all documents share
amid texts of their own, is hot. Its phrases go to no bucket; its windows do, each to a bucket of its
own bytes' hash, where equal ones (by 128 bits) take their least document. So a bucket holds at most
``HOT`` phrases of a trigger from each part, whatever the number of documents.

A phrase that a third of all documents share is one row for each part in step 1 and one entry in
each answer, so no task sees its occurrences. Parts are read again rather than kept: parsing is
cheaper than storing a parse.

A phrase's name is a hash of its bytes of 127 bits under a key that the driver draws for each run, and
so are the 128 bits that stand for a hot trigger's window: no text can be made so that different
bytes get one name, and by chance it happens with a probability of some 2^-120 for each pair. Sums
under the rolling hash, for which such texts exist, only choose triggers and buckets.

Defined cases: a null text is empty; a document shorter than 50 bytes loses nothing; a null doc_id
is not smaller than any, so it loses nothing and takes nothing; rows of equal doc_id do not repeat
each other; repeated rows are each judged; an empty table gives an empty result; other columns are
ignored, whatever their names. Texts are parsed whole, as UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import input_bytes, lean, parts, small_batches, table, written_once
from quarry.llm.shingles import mixed

#: Fixed value: the length of a repeat. The trigger's length leaves 32 places for it in a window.
WINDOW = 50
TRIGGER = 19
PLACES = WINDOW - TRIGGER + 1
#: Input bytes of a part, and the most parts; parts are also the buckets.
PART_BYTES, MOST_PARTS = 8 << 20, 50_000
#: Text bytes parsed at a time.
CHUNK = 2 << 20
#: Phrases of one trigger that a part sends to the trigger's bucket.
HOT = 128
NEVER = np.iinfo("i8").max

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_CODES = mixed(np.arange(1, 257, dtype="u8") * _U(0xD6E8FEB86659FD93))


def _series(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the rolling hash's base and of its inverse, as many as a chunk has needed so far."""

    up = _series(_BASE, 1 << 16)
    down = _series(pow(_BASE, -1, 1 << 64), 1 << 16)

    @classmethod
    def upto(cls, n: int) -> None:
        if n > len(cls.up):
            cls.up = _series(_BASE, 1 << n.bit_length())
            cls.down = _series(pow(_BASE, -1, 1 << 64), 1 << n.bit_length())


#: A phrase's name: 16 bytes, the last of them odd, so that none is lost where trailing zeros don't count.
NAME = "S16"


def new_key() -> int:
    return secrets.randbits(64)


def _names(data: bytes, at: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    out = np.frombuffer(b"".join([digest(data[a:b], key) for a, b in zip(at.tolist(), end.tolist(), strict=True)]), "u1").copy()
    out[15::16] |= 1
    return out.view(NAME)


def _high(name: np.ndarray) -> np.ndarray:
    """The first half of each name, as a number."""
    return np.ascontiguousarray(name).view(">u8")[::2].astype("u8")


def _ordered(name: np.ndarray, first: tuple[np.ndarray, ...] = (), last: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """Order by ``first``, name and ``last``. Halves of names sort faster; should two share one, whole names are sorted."""
    high = _high(name)
    order = np.lexsort((*last[::-1], high, *first[::-1]))
    doubtful = ~_runs(high[order], *(f[order] for f in first))[1:]
    sorted_names = name[order]
    if (doubtful & (sorted_names[1:] != sorted_names[:-1])).any():
        return np.lexsort((*last[::-1], name, *first[::-1]))
    return order


class _Names:
    """Sorted names to look others up in; of equal ones the first is found."""

    def __init__(self, names: np.ndarray):
        self.names, high = names, _high(names)
        self.high = None if ((high[1:] == high[:-1]) & (names[1:] != names[:-1])).any() else high

    def find(self, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each is or would be, and whether it is there."""
        place = np.searchsorted(self.names, name) if self.high is None else np.searchsorted(self.high, _high(name))
        place = np.minimum(place, len(self.names) - 1)
        return place, self.names[place] == name


def parse(texts: list[bytes], key: int) -> tuple[np.ndarray, ...]:
    """The parse of a chunk: per phrase its trigger, name, document, first window and windows; and the joined bytes.

    First windows are places in the joined bytes.
    """
    raw = b"".join(texts)
    data = np.frombuffer(raw, "u1")
    lengths = np.array([len(t) for t in texts], "i8")
    starts = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - WINDOW + 1, 0)
    if not windows.sum():
        none = np.zeros(0, "i8")
        return none.view("u8"), none.view(NAME), none, none, none, data
    n = len(data)
    _Powers.upto(n + 1)
    sums = np.zeros(n + 1, "u8")
    np.cumsum(_CODES[data] * _Powers.up[:n], out=sums[1:])
    least = mixed((sums[TRIGGER:] - sums[:-TRIGGER]) * _Powers.down[: n - TRIGGER + 1])
    width = 1
    while width < PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    owner = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    trigger = least[place]
    new = np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(trigger)])))
    at = place[first]
    return trigger[first], _names(raw, at, at + count + WINDOW - 1, key), owner[first], at, count, data


def _chunks(rows: Iterator[tuple[int | None, bytes]]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0
    for doc, text in rows:
        if texts and size + len(text) > CHUNK:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


#: Messages between parts and buckets, and documents on their way to a part, in one shape.
MESSAGE = "to int, kind int, sender int, doc_id long, text string, a binary, b binary, c binary, d binary"
_NAMES = [f.split()[0] for f in MESSAGE.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), *[pa.binary()] * 4]
DICTIONARY, PENDING, ASKED, PHRASES, SIMPLE, WINDOWED, IS_HOT, ASKED_HOT, HOT_WINDOWS, HOT_TOLD, DOCUMENT = range(11)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (to, kind, sender, arrays...)."""
    full = [(to, kind, sender, None, None, *(x.tobytes() for x in arrays), *[None] * (4 - len(arrays))) for to, kind, sender, *arrays in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*full, strict=True), _TYPES, strict=True)], _NAMES)


def _sent(rows: list[tuple], at_once: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), at_once):
        yield _messages(rows[k : k + at_once])


def _split(to: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows for each receiver that gets any."""
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]


def _texts(batch: pa.RecordBatch, id_at: int, text_at: int) -> Iterator[tuple[int | None, bytes]]:
    for doc, text in zip(batch.column(id_at).to_pylist(), batch.column(text_at), strict=True):
        yield doc, (text.as_py() or "").encode("utf-8", "surrogatepass")


def _dictionary(trigger: np.ndarray, content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each phrase once: trigger, content, least document, whether it has several."""
    order = _ordered(content, (trigger,))
    trigger, content, doc = trigger[order], content[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (content[1:] != content[:-1]))))
    low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
    return trigger[first], content[first], low, low < high


def _send_dictionary(buckets: int, key: int):
    """A part's phrases, once each for every few chunks, to the buckets of their triggers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, sender = 0, -1

        def flush() -> Iterator[pa.RecordBatch]:
            trigger, content, low, several = _dictionary(*(np.concatenate(c) for c in zip(*held, strict=True)))
            starts = np.flatnonzero(_runs(trigger))
            size = np.diff(np.concatenate((starts, [len(trigger)])))
            hot, many = trigger[starts[size > HOT]], np.repeat(size > HOT, size)
            rows = [(k, IS_HOT, sender, hot[own]) for k, own in _split((hot % _U(buckets)).astype("i8"), buckets)]
            trigger, content, low, several = (x[~many] for x in (trigger, content, low, several))
            for k, rows_of in _split((trigger % _U(buckets)).astype("i8"), buckets):
                rows.append((k, DICTIONARY, sender, (trigger[rows_of] // _U(buckets)).astype("u4"), content[rows_of], low[rows_of], several[rows_of]))
            return _sent(rows)

        def rows() -> Iterator[tuple[int | None, bytes]]:
            nonlocal sender
            for batch in batches:
                if batch.num_rows:
                    sender = batch.column(0)[0].as_py()
                yield from _texts(batch, 1, 2)

        for ids, texts in _chunks(rows()):
            trigger, content, owner, *_ = parse(texts, key)
            named = np.array([i is not None for i in ids])[owner]
            doc = np.array([i or 0 for i in ids], "i8")[owner]
            if named.any():
                held.append((trigger[named], content[named], doc[named]))
                size += int(named.sum())
            if size > 2_000_000:
                yield from flush()
                held.clear()
                size = 0
        if held:
            yield from flush()

    return run


def _gather(batches: Iterator[pa.RecordBatch], kinds: dict[int, tuple[str, ...]]) -> tuple[int, dict[int, list[np.ndarray]], dict[int, np.ndarray]]:
    """A bucket's messages: its number, and per kind the joined arrays and their senders."""
    got: dict[int, list[list[np.ndarray]]] = {k: [] for k in kinds}
    senders: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    bucket = -1
    for batch in batches:
        for row in zip(*(batch.column(k) for k in (0, 1, 2, 5, 6, 7, 8)), strict=True):
            bucket, kind = row[0].as_py(), row[1].as_py()
            arrays = [np.frombuffer(cell.as_buffer(), dtype) for cell, dtype in zip(row[3:], kinds[kind])]
            got[kind].append(arrays)
            senders[kind].append(np.full(len(arrays[0]), row[2].as_py(), "i4"))
    joined = {k: [np.concatenate(c) for c in zip(*v, strict=True)] if v else [np.zeros(0, d) for d in kinds[k]] for k, v in got.items()}
    return bucket, joined, {k: np.concatenate(v) if v else np.zeros(0, "i4") for k, v in senders.items()}


def _runs(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _settle(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _settle_bucket(batches, buckets)

    return run


def _settle_bucket(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A bucket's triggers: answers where one phrase tells all, questions where phrases differ, and which are hot."""
    bucket, got, senders = _gather(batches, {DICTIONARY: ("u4", NAME, "i8", "?"), IS_HOT: ("u8",)})
    trigger, content, low, several = got[DICTIONARY]
    sender = senders[DICTIONARY]
    if len(got[IS_HOT][0]):
        # Every part that has any phrase of a hot trigger is asked for its windows.
        hot = np.unique(got[IS_HOT][0])
        is_hot = np.isin(trigger, (hot // _U(buckets)).astype("u4"))
        yield from _sent([(int(k), ASKED_HOT, bucket, hot) for k in np.unique(np.concatenate((senders[IS_HOT], sender[is_hot])))])
        trigger, content, low, several, sender = (x[~is_hot] for x in (trigger, content, low, several, sender))
    if not len(trigger):
        return
    order = _ordered(content, (trigger,), (low,))
    trigger, content, low, several, sender = (x[order] for x in (trigger, content, low, several, sender))
    starts = np.flatnonzero(_runs(trigger))
    lowest, highest = np.minimum.reduceat(low, starts), np.maximum.reduceat(low, starts)
    shared = (lowest < highest) | np.logical_or.reduceat(several, starts)
    phrase_new = _runs(trigger, content)
    phrases = np.add.reduceat(phrase_new.astype("i8"), starts)
    size = np.diff(np.concatenate((starts, [len(trigger)])))
    alone = np.repeat(shared & (phrases == 1), size)
    mixed_up = np.repeat(shared & (phrases > 1), size)
    phrase_of = np.cumsum(phrase_new) - 1
    phrase_low = low[phrase_new]  # rows of a phrase start with its least document
    own_low = phrase_low[phrase_of]
    rows = []
    many = int(sender.max()) + 1
    tell = np.flatnonzero(alone & (several | (low > own_low)))
    for k, at in _split(sender[tell], many):
        rows.append((k, SIMPLE, bucket, content[tell[at]], own_low[tell[at]]))
    ask = np.flatnonzero(mixed_up & phrase_new)
    for k, at in _split(sender[ask], many):
        rows.append((k, ASKED, bucket, content[ask[at]]))
    wait = np.flatnonzero(mixed_up)
    for k in range(0, len(wait), 500_000):
        at = wait[k : k + 500_000]
        rows.append((bucket, PENDING, -1, trigger[at], content[at], np.stack([low[at], sender[at].astype("i8")], 1), several[at]))
    yield from _sent(rows)


def window_prints(data: np.ndarray, places: np.ndarray, key: int) -> np.ndarray:
    """128 bits of each window at ``places``: two columns, each a sum of bytes' codes times odd factors, all drawn under the key."""
    drawn = np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 64, (2, 256 + WINDOW), "u8", endpoint=False)
    code, factor = drawn[:, :256], drawn[:, 256:] | _U(1)
    out = np.zeros((len(places), 2), "u8")
    for k in range(WINDOW):
        byte = data[places + k]
        for lane in (0, 1):
            out[:, lane] += code[lane][byte] * factor[lane, k]
    return mixed(out)


def _hot(hot: np.ndarray, trigger: np.ndarray) -> np.ndarray:
    """Which phrases have a hot trigger."""
    if not len(hot):
        return np.zeros(0, "i8")
    return np.flatnonzero(hot[np.minimum(np.searchsorted(hot, trigger), len(hot) - 1)] == trigger)


def _windows_of(own: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the phrases ``own``: which one, and the place, of each of their windows."""
    which = np.repeat(np.arange(len(own)), count[own])
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count[own]) - count[own], count[own]) + at[own][which]


def _hot_windows(hot: np.ndarray, ids: list[int | None], parsed: tuple[np.ndarray, ...], buckets: int, part: int, key: int) -> Iterator[pa.RecordBatch]:
    """The windows of a chunk's phrases of hot triggers, equal ones once with their least document, to the buckets of their prints."""
    trigger, content, owner, at, count, data = parsed
    on = _hot(hot, trigger)
    on = on[np.array([i is not None for i in ids])[owner[on]]]
    if not len(on):
        return
    doc = np.array([i or 0 for i in ids], "i8")[owner[on]]
    order = np.lexsort((doc, content[on]))
    on, doc = on[order], doc[order]
    starts = np.flatnonzero(_runs(content[on]))
    low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    held = []
    for a in range(0, len(starts), 4096):
        which, places = _windows_of(on[starts[a : a + 4096]], at, count)
        held.append((window_prints(data, places, key), low[a : a + 4096][which], high[a : a + 4096][which]))
    prints, low, high = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((prints[:, 1], prints[:, 0]))
    prints = prints[order]
    starts = np.flatnonzero(_runs(prints[:, 0], prints[:, 1]))
    low, high = np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)
    prints, pair = prints[starts], np.stack([low, (low < high).astype("i8")], 1)
    yield from _sent([(b, HOT_WINDOWS, part, prints[r], pair[r]) for b, r in _split((prints[:, 0] % _U(buckets)).astype("i8"), buckets)])


def _answer(buckets: int, key: int):
    """The phrases that buckets asked a part for, with their bytes, and the windows of those that are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[np.ndarray] = []
        asked_hot: list[np.ndarray] = [np.zeros(0, "u8")]
        hot, wanted = np.zeros(0, "u8"), _Names(np.zeros(0, NAME))
        given = np.zeros(0, bool)
        part = -1

        def rows() -> Iterator[tuple[int | None, bytes]]:
            nonlocal wanted, given, part, hot
            for batch in batches:
                kinds = np.array(batch.column(1).to_pylist())
                for k in np.flatnonzero(kinds == ASKED_HOT):
                    asked_hot.append(np.frombuffer(batch.column(5)[k].as_buffer(), "u8"))
                for k in np.flatnonzero(kinds == ASKED):
                    asked.append(np.frombuffer(batch.column(5)[k].as_buffer(), NAME))
                if batch.num_rows:
                    part = batch.column(0)[0].as_py()
                documents = batch.filter(pa.array(kinds == DOCUMENT))
                if documents.num_rows:
                    if len(asked_hot) > 1:
                        hot = np.unique(np.concatenate([hot, *asked_hot]))
                        del asked_hot[1:]
                    if asked:
                        wanted = _Names(np.unique(np.concatenate([wanted.names, *asked])))
                        given = np.zeros(len(wanted.names), bool)
                        asked.clear()
                    yield from _texts(documents, 3, 4)

        for ids, texts in _chunks(rows()):
            if not len(wanted.names) and not len(hot):
                continue
            trigger, content, _, at, count, data = parsed = parse(texts, key)
            if len(hot) and len(trigger):
                yield from _hot_windows(hot, ids, parsed, buckets, part, key)
            if not len(wanted.names):
                continue
            place, there = wanted.find(content)
            hit = np.flatnonzero(there & ~given[place])
            hit = hit[np.unique(place[hit], return_index=True)[1]]
            if not len(hit):
                continue
            given[place[hit]] = True
            out = []
            for k, own in _split((trigger[hit] % _U(buckets)).astype("i8"), buckets):
                own = hit[own]
                size = count[own] + WINDOW - 1
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[own], size)
                out.append((k, PHRASES, part, content[own], count[own].astype("u4"), data[inside]))
            yield from _sent(out)

    return run


def suffix_order(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows at ``places`` by their 50 bytes, and where a new one starts in that order."""
    padded = np.concatenate((data, np.zeros(8, "u1")))
    big = lambda shift, n: sum(padded[places + shift + k].astype("u8") << _U(8 * (7 - k)) for k in range(n))
    keys = [big(s, min(8, WINDOW - s)) for s in range(0, WINDOW, 8)]
    order = np.lexsort(keys[::-1])
    return order, _runs(*(k[order] for k in keys))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the phrases asked for, in suffix order, and the answers to all parts that have them."""
    phrases: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, ...]] = []
    windows: list[tuple[np.ndarray, ...]] = []
    bucket = -1
    for batch in batches:
        for row in zip(*(batch.column(k) for k in (0, 1, 5, 6, 7, 8, 2)), strict=True):
            bucket = row[0].as_py()
            cells = [c.as_buffer() for c in row[2:6] if c.is_valid]
            if row[1].as_py() == HOT_WINDOWS:
                prints, pair = (np.frombuffer(c, d).reshape(-1, 2) for c, d in zip(cells, ("u8", "i8"), strict=True))
                windows.append((prints, pair, np.full(len(prints), row[6].as_py(), "i4")))
            elif row[1].as_py() == PHRASES:
                phrases.append(tuple(np.frombuffer(c, d) for c, d in zip(cells, (NAME, "u4", "u1"), strict=True)))
            else:
                trigger, content, pair, several = (np.frombuffer(c, d) for c, d in zip(cells, ("u4", NAME, "i8", "?"), strict=True))
                waiting.append((content, pair.reshape(-1, 2)[:, 0], pair.reshape(-1, 2)[:, 1], several))
    if windows:
        yield from _match_hot(bucket, *(np.concatenate(c) for c in zip(*windows, strict=True)))
    if not waiting:
        return
    content, low, sender, several = (np.concatenate(c) for c in zip(*waiting, strict=True))
    name, count, data = (np.concatenate(c) for c in zip(*phrases, strict=True))
    count = count.astype("i8")
    size = count + WINDOW - 1
    begin = np.cumsum(size) - size
    order = np.lexsort((low, content))
    content, low, sender, several = (x[order] for x in (content, low, sender, several))
    firsts = np.flatnonzero(_runs(content))
    least = np.full(len(name), NEVER)
    where = np.minimum(np.searchsorted(content[firsts], name), len(firsts) - 1)
    known = content[firsts][where] == name
    least[known] = low[firsts[where[known]]]
    first_window = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(name)), count)
    places = np.arange(len(owner)) - np.repeat(first_window, count) + np.repeat(begin, count)
    order, new = suffix_order(data, places)
    runs = np.flatnonzero(new)
    run_least = np.minimum.reduceat(least[owner[order]], runs)
    window_least = np.empty(len(owner), "i8")
    window_least[order] = run_least[np.cumsum(new) - 1]
    by_name = np.argsort(name, kind="stable")
    at = by_name[np.searchsorted(name[by_name], content)]
    phrase_least = np.minimum.reduceat(window_least, first_window)
    tell = np.flatnonzero(several | (low > phrase_least[at]))
    rows = []
    for k, own in _split(sender[tell], int(sender.max()) + 1):
        chosen = at[tell[own]]
        many = count[chosen]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first_window[chosen], many)
        rows.append((k, WINDOWED, bucket, content[tell[own]], many.astype("u4"), window_least[inside]))
    yield from _sent(rows)


def _match_hot(bucket: int, prints: np.ndarray, pair: np.ndarray, sender: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Equal windows of hot triggers, and the answers to all parts that have them."""
    order = np.lexsort((prints[:, 1], prints[:, 0]))
    new = _runs(prints[order, 0], prints[order, 1])
    least = np.empty(len(order), "i8")
    least[order] = np.minimum.reduceat(pair[order, 0], np.flatnonzero(new))[np.cumsum(new) - 1]
    tell = np.flatnonzero((pair[:, 1] > 0) | (pair[:, 0] > least))
    yield from _sent([(s, HOT_TOLD, bucket, prints[tell[own]], least[tell[own]]) for s, own in _split(sender[tell], int(sender.max()) + 1)])


class _HotTold:
    """What a part was told of its windows of hot triggers."""

    def __init__(self) -> None:
        self.triggers: list[np.ndarray] = [np.zeros(0, "u8")]
        self.answers: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, 2), "u8"), np.zeros(0, "i8"))]

    def settle(self) -> None:
        self.hot = np.unique(np.concatenate(self.triggers))
        prints, self.least = (np.concatenate(c) for c in zip(*self.answers, strict=True))
        order = np.lexsort((prints[:, 1], prints[:, 0]))
        self.one, self.two, self.least = prints[order, 0], prints[order, 1], self.least[order]

    def gone(self, ids: list[int | None], parsed: tuple[np.ndarray, ...], key: int) -> np.ndarray:
        """Places of windows that a smaller document has."""
        trigger, _, owner, at, count, data = parsed
        own = _hot(self.hot, trigger) if len(self.one) else np.zeros(0, "i8")
        doc = np.array([-NEVER if i is None else i for i in ids], "i8")
        out = [np.zeros(0, "i8")]
        for a in range(0, len(own), 4096):
            which, places = _windows_of(own[a : a + 4096], at, count)
            prints = window_prints(data, places, key)
            for first in (np.searchsorted(self.one, prints[:, 0]), np.searchsorted(self.one, prints[:, 0], side="right") - 1):
                k = np.clip(first, 0, len(self.one) - 1)
                hit = (self.one[k] == prints[:, 0]) & (self.two[k] == prints[:, 1]) & (self.least[k] < doc[owner[own[a : a + 4096]]][which])
                out.append(places[hit])
        return np.unique(np.concatenate(out))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _cut(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_part(batches, key)

    return run


def _cut_part(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """A part's documents with the repeated bytes found."""
    told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    hot = _HotTold()
    ready = False
    names = _Names(np.zeros(0, NAME))
    count = start = least = np.zeros(0, "i8")

    def rows() -> Iterator[tuple[int | None, bytes]]:
        nonlocal ready, names, count, start, least
        for batch in batches:
            kinds = np.array(batch.column(1).to_pylist())
            for k in np.flatnonzero(kinds != DOCUMENT):
                cells = [batch.column(c)[int(k)] for c in (5, 6, 7)]
                content = np.frombuffer(cells[0].as_buffer(), "u8" if kinds[k] in (ASKED_HOT, HOT_TOLD) else NAME)
                if kinds[k] == ASKED_HOT:
                    hot.triggers.append(content)
                elif kinds[k] == HOT_TOLD:
                    hot.answers.append((content.reshape(-1, 2), np.frombuffer(cells[1].as_buffer(), "i8")))
                elif kinds[k] == SIMPLE:
                    told.append((content, np.zeros(len(content), "i8"), np.frombuffer(cells[1].as_buffer(), "i8")))
                else:
                    told.append((content, np.frombuffer(cells[1].as_buffer(), "u4").astype("i8"), np.frombuffer(cells[2].as_buffer(), "i8")))
            documents = batch.filter(pa.array(kinds == DOCUMENT))
            if documents.num_rows and not ready:
                ready = True
                hot.settle()
                if told:
                    # One value tells all windows of a phrase (count 0), or each window has its own.
                    content, many, values = (np.concatenate(c) for c in zip(*told, strict=True))
                    took = np.maximum(many, 1)
                    begin = np.cumsum(took) - took
                    order = _ordered(content)
                    names, count, start, least = _Names(content[order]), many[order], begin[order], values
            yield from _texts(documents, 3, 4)

    for ids, texts in _chunks(rows()):
        _, content, owner, at, windows, data = parsed = parse(texts, key)
        cover = np.zeros(len(data) + 1, "i8")
        if len(hot.hot) and len(content) and len(gone := hot.gone(ids, parsed, key)):
            cover += np.bincount(gone, minlength=len(cover)) - np.bincount(gone + WINDOW, minlength=len(cover) + WINDOW)[: len(cover)]
        if len(names.names) and len(content):
            place, there = names.find(content)
            hit = np.flatnonzero(there)
            place = place[hit]
            each = windows[hit]
            phrase = np.repeat(np.arange(len(hit)), each)
            k = np.arange(len(phrase)) - np.repeat(np.cumsum(each) - each, each)
            value = least[start[place][phrase] + np.where(count[place][phrase] > 0, k, 0)]
            doc = np.array([-NEVER if i is None else i for i in ids], "i8")[owner[hit]][phrase]
            gone = (at[hit][phrase] + k)[value < doc]
            cover += np.bincount(gone, minlength=len(cover)) - np.bincount(gone + WINDOW, minlength=len(cover) + WINDOW)[: len(cover)]
        removed = np.cumsum(cover)[:-1] > 0
        out, first = [], 0
        for doc, text in zip(ids, texts, strict=True):
            own = removed[first : first + len(text)]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view("i1"), [0]))))
            kept = data[first : first + len(text)][~own].tobytes()
            spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
            out.append((doc, len(text), int(own.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            first += len(text)
        span = pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))
        types = [pa.int64()] * 4 + [pa.string(), span]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.split()[0] for f in RESULT.split(", ")])


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed): one row for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    key = new_key()
    n = min(MOST_PARTS, max(parts(spark), ceil(input_bytes(docs) / PART_BYTES)))
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("to"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    as_message = rows.select(
        "to", F.lit(DOCUMENT).alias("kind"), F.lit(-1).alias("sender"), "doc_id", "text", *(F.lit(None).cast("binary").alias(c) for c in "abcd")
    )

    def delivered(messages: DataFrame) -> DataFrame:
        return messages.repartitionById(n, F.col("to")).sortWithinPartitions("to", "kind")

    sent = rows.repartitionById(n, F.col("to")).mapInArrow(lean(_send_dictionary(n, key)), MESSAGE)
    found = written_once(sent.repartitionById(n, F.col("to")).mapInArrow(lean(_settle(n)), MESSAGE), "repeats-found")
    questions = delivered(found.filter(F.col("kind").isin(ASKED, ASKED_HOT)).unionByName(as_message))
    phrases = questions.mapInArrow(lean(_answer(n, key)), MESSAGE)
    matched = written_once(
        phrases.unionByName(found.filter(F.col("kind") == PENDING)).repartitionById(n, F.col("to")).mapInArrow(lean(_match), MESSAGE), "repeats-matched"
    )
    answers = found.filter(F.col("kind").isin(SIMPLE, ASKED_HOT)).unionByName(matched)
    return delivered(answers.unionByName(as_message)).mapInArrow(lean(_cut(key)), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents")).drop("spans")
