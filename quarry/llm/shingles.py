"""Word shingles as 64-bit hashes, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

#: Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


_table = _powers(1 << 12)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words end."""
    global _table
    coded = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", "u1")
    lettered = data != 32
    turns = np.flatnonzero(lettered[1:] != lettered[:-1]) + 1
    if lettered[0]:
        turns = np.concatenate(([0], turns))
    starts, ends = turns[0::2], turns[1::2]
    if not len(starts):
        return np.zeros(0, "u8"), np.zeros(len(texts), "i8")
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_table):
        _table = _powers(1 << longest.bit_length())
    inside = np.flatnonzero(lettered)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    hashes = np.add.reduceat((data[inside].astype("u8") + _U(1)) * _table[place], first)
    text_ends = np.cumsum([len(c) + 1 for c in coded])
    return mixed(hashes), np.searchsorted(starts, text_ends, side="left")


def shingle_sets(texts: list[str | None], size: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingles, rising, and how often each occurs.

    A text of fewer words than ``size``, but not none, is one shingle of all its words.
    """
    words, ends = word_hashes(texts)
    n = len(words)
    whole = np.zeros(max(0, n - size + 1), "u8")
    for k in range(size):
        if len(whole):
            whole = whole * _STEP + words[k : k + len(whole)]
    whole = mixed(whole)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= size:
            out.append(np.unique(whole[start : end - size + 1], return_counts=True))
        elif end > start:
            one = np.array([end - start], "u8")
            for k in range(start, end):
                one = one * _STEP + words[k : k + 1]
            out.append((mixed(one), np.ones(1, "i8")))
        else:
            out.append((np.zeros(0, "u8"), np.zeros(0, "i8")))
        start = end
    return out
