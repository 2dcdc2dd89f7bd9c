"""DartMinHash: weighted signatures from hashed darts.

The darts at an element are a Poisson process over weight and rank, drawn from hashes of the
element alone: cell after cell of unit weight, and in a cell rank after rank, with exponential
gaps. A dart hits a document if its weight is below the element's weight there. Each dart belongs
to one coordinate; a document's signature keeps, for each coordinate, the earliest dart that hits
it. Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Ranks are followed only up to a bound that gives about ``k (ln k + 4)`` darts whatever the
document's size, so a signature costs one look at each element and those darts; documents with a
coordinate still open go on with twice the bound.
"""

from __future__ import annotations

from math import log

import numpy as np

from quarry.llm.shingles import mixed

_U = np.uint64
_CELL, _DART, _WHERE, _WEIGHT, _NAME = (_U(c) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))


def _times(n: int, constant: np.uint64) -> np.uint64:
    return _U(n * int(constant) & 0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> _U(11)).astype("f8") + 1) * (1.0 / (1 << 53))


def throw(elements: np.ndarray, owner: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """owner, coordinate, rank and name of every dart that hits with a rank up to its owner's ``bound``."""
    cells = np.ceil(weight).astype("i8")
    if (cells > 1).any():
        which = np.repeat(np.arange(len(elements)), cells)
        cell = np.arange(len(which)) - np.repeat(np.concatenate(([0], np.cumsum(cells)[:-1])), cells)
        room = weight[which] - cell
        seed, own = mixed(elements[which] + cell.astype("u8") * _CELL), owner[which]
    else:
        room, seed, own = weight, mixed(elements.copy()), owner
    limit = bound[own]
    rank = np.zeros(len(seed))
    out: list[tuple[np.ndarray, ...]] = []
    turn = 0
    # A gap is -ln u. The first is compared before any logarithm is taken: most elements have no dart.
    miss = np.exp(-limit)
    while len(seed):
        turn += 1
        u = _unit(mixed(seed + _times(turn, _DART)))
        if turn == 1:
            near = u >= miss
            u, seed, own, room, limit, rank = (a[near] for a in (u, seed, own, room, limit, rank))
        gap = -np.log(u)
        rank = rank + gap
        keep = rank <= limit
        seed, own, room, limit, rank = (a[keep] for a in (seed, own, room, limit, rank))
        if len(seed):
            name = mixed(seed + _times(turn, _NAME))
            hit = _unit(mixed(name ^ _WEIGHT)) <= room
            out.append((own[hit], (mixed(name ^ _WHERE) % _U(k)).astype("i8")[hit], rank[hit], name[hit]))
    if not out:
        none = np.zeros(0, "i8")
        return none, none, np.zeros(0), np.zeros(0, "u8")
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of ``k`` dart names for each (elements, weights); zeros for a document without elements."""
    out = np.zeros((len(sets), k), "u8")
    sums = np.array([float(w.sum()) for _, w in sets])
    todo = np.flatnonzero(sums > 0)
    scale = k * (log(k) + 4)
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weight = np.concatenate([sets[i][1] for i in todo]).astype("f8")
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        own, at, rank, name = throw(elements, owner, weight, scale / sums[todo], k)
        earliest = np.argsort(-rank, kind="stable")
        rows = np.zeros((len(todo), k), "u8")
        filled = np.zeros((len(todo), k), bool)
        rows[own[earliest], at[earliest]] = name[earliest]
        filled[own, at] = True
        done = filled.all(1)
        out[todo[done]] = rows[done]
        todo, scale = todo[~done], scale * 2
    return out
