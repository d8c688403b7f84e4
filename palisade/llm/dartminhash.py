"""DartMinHash signatures of weighted sets, vectorised.

Every element owns a strip of the plane (weight across, rank upwards) into which hashed darts fall as a Poisson
process; a set sees the darts that lie below its elements' weights.  The strip is cut into unit regions, one for each
unit of weight, the last one partly covered.  Each dart belongs to one of ``k`` coordinates; the dart of least rank in
a coordinate is its minimum.  Two sets agree in a coordinate with probability equal to their weighted Jaccard
similarity.  Only ranks up to about (k ln k + 2k) / total weight are looked at; sets with an empty coordinate look on.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + _A
    x = (x ^ (x >> U(30))) * _B
    x = (x ^ (x >> U(27))) * _C
    return x ^ (x >> U(31))


def regions(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unit regions below each element's weight: their ids, their elements' places, and how much of each is covered."""
    layers = np.ceil(weights).astype(np.int64)
    layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
    place = np.repeat(np.arange(len(elements)), layers)
    return mix(elements[place] ^ mix(layer.astype(U))), place, np.minimum(weights[place] - layer, 1.0)


def signatures(elements: np.ndarray, weights: np.ndarray | None, sizes: np.ndarray, k: int) -> np.ndarray:
    """(sets, k) uint64.  elements: uint64 ids, set after set; weights: positive, or None for 1 each; sizes: elements of each set, all positive."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    if weights is None:
        total, limit = sizes.astype(float), None
    else:
        total = np.bincount(of, weights, minlength=len(sizes))
        elements, place, limit = regions(elements, weights)
        of = of[place]
    out = np.zeros((len(sizes), k), U)
    todo, reach = np.arange(len(sizes)), k * (np.log(k) + 2.0)
    while len(todo):
        place = np.full(len(sizes), -1)
        place[todo] = np.arange(len(todo))
        chosen = place[of] >= 0
        best = np.full(len(todo) * k, np.inf)
        won = np.zeros(len(todo) * k, U)
        x, d, rank = elements[chosen], place[of[chosen]], np.zeros(int(chosen.sum()))
        lim = None if limit is None else limit[chosen]
        top = reach / total[todo]
        i = 0
        while len(x):
            i += 1
            u = mix(x ^ U(i * int(_C) % 2**64))
            rank = rank - np.log((u >> U(11)).astype(float) * 2.0**-53 + 2.0**-54)
            alive = rank <= top[d]
            x, d, rank, u = x[alive], d[alive], rank[alive], u[alive]
            value = mix(u)
            if lim is None:
                key, r, v = d * k + (value % U(k)).astype(np.int64), rank, value
            else:
                lim = lim[alive]
                seen = (mix(value) >> U(11)).astype(float) * 2.0**-53 < lim
                key, r, v = (d * k + (value % U(k)).astype(np.int64))[seen], rank[seen], value[seen]
            np.minimum.at(best, key, r)
            first = best[key] == r
            won[key[first]] = v[first]
        full = np.isfinite(best).reshape(len(todo), k).all(axis=1)
        out[todo[full]] = won.reshape(len(todo), k)[full]
        todo, reach = todo[~full], reach * 2
    return out


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """(sets, k // rows) int64: one hash for each band of ``rows`` coordinates, the band's number mixed in."""
    n, k = sig.shape
    h = np.zeros((n, k // rows), U) + np.arange(k // rows, dtype=U)
    parts = sig.reshape(n, k // rows, rows)
    for j in range(rows):
        h = mix(h ^ parts[:, :, j])
    return h.view(np.int64)
