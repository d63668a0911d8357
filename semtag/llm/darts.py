"""DartMinHash signatures of weighted sets.

Every element owns a plane of rank by weight on which hashed darts fall as a Poisson process of unit
rate. An element of weight w catches the darts below w. Each dart is thrown at one of k coordinates; a
coordinate keeps the earliest dart (least rank) that the set caught. Two sets agree on a coordinate
with the probability of their weighted Jaccard similarity. A set of total weight W need only look at
ranks up to about k ln k / W, so a signature costs one pass over the elements and k ln k darts.

The plane is cut into areas whose darts depend on element and area alone: ranks [0, 1/128), then doubling
intervals; weights [0, 1), then doubling intervals; areas over 1 are cut further into cells.
"""

from __future__ import annotations

import math

import numpy as np

FIRST_RANK = 2.0**-7
_CDF = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def poisson_cdf(area: float) -> np.ndarray:
    if area not in _CDF:
        terms = np.cumsum([math.exp(-area) * area**i / math.factorial(i) for i in range(18)])
        _CDF[area] = terms
    return _CDF[area]


def darts(elements: np.ndarray, weights: np.ndarray, limits: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the element, rank, hash) of every dart caught at a rank up to the element's limit, at least."""
    found, scrambled = [], mix(elements ^ np.uint64(seed))
    low, width, level, most_rank = 0.0, FIRST_RANK, 0, float(limits.max())
    most_weight = float(weights.max())
    while low < most_rank:
        from_weight, tall, layer = 0.0, 1.0, 0
        while from_weight < most_weight:
            at = np.flatnonzero((limits > low) & (weights > from_weight))
            cells = max(1, math.ceil(width * tall))
            cdf = poisson_cdf(width * tall / cells)
            for cell in range(cells if len(at) else 0):
                area_id = ((level << 48) | (layer << 40) | cell) * 0xD6E8FEB86659FD93 % 2**64
                h = mix(scrambled[at] ^ np.uint64(area_id))
                u = unit(h)
                hit = np.flatnonzero(u > cdf[0])
                counts = np.searchsorted(cdf, u[hit])
                for i in range(int(counts.max()) if len(hit) else 0):
                    some = hit[counts > i]
                    one = mix(h[some] + np.uint64((i + 1) * 0xA24BAED4963EE407 % 2**64))
                    two, who = mix(one), at[some]
                    rank = low + width * (cell + unit(one)) / cells
                    if most_weight > 1 or weights.min() < 1:  # else every dart is caught
                        caught = from_weight + tall * unit(mix(two)) < weights[who]
                        who, rank, two = who[caught], rank[caught], two[caught]
                    found.append((who, rank, two))
            from_weight, tall, layer = from_weight + tall, from_weight + tall, layer + 1
        low, width, level = low + width, low + width, level + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0, np.uint64))


def signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None, seed: int = 8) -> np.ndarray:
    """(set, coordinate) -> hash of its earliest dart, as uint64. Sets hold distinct uint64 elements, at least one each."""
    out = np.zeros((len(sets), k), np.uint64)
    todo, slack = np.arange(len(sets)), 3.0
    while len(todo):
        sizes = np.array([len(sets[i]) for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        elements = np.concatenate([sets[i] for i in todo])
        w = np.concatenate([weights[i] for i in todo]).astype(float) if weights is not None else np.ones(len(elements))
        limit = k * (math.log(k) + slack) / np.bincount(owner, w, len(todo))
        position, rank, h = darts(elements, w, limit[owner], seed)
        keep = rank <= limit[owner[position]]
        position, rank, h = position[keep], rank[keep], h[keep]
        slot = owner[position] * k + (h % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank)  # the earliest is written last
        rows, filled = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        rows[slot[order]], filled[slot] = h[order], True
        whole = filled.reshape(len(todo), k).all(axis=1)
        out[todo[whole]] = rows.reshape(len(todo), k)[whole]
        todo, slack = todo[~whole], slack + 10
    return out
