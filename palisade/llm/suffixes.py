"""Suffix sorting by the difference cover {1, 2} modulo 3, vectorised, exact for the first ``DEPTH`` bytes."""

from __future__ import annotations

import numpy as np

#: Suffixes that agree in so many bytes may stand in any order.
DEPTH = 50


def order(s: np.ndarray, width: int = 1) -> np.ndarray:
    """Starts of the suffixes of ``s`` (non-negative int64), sorted; each symbol stands for ``width`` bytes.

    Sampled triples (starts not divisible by 3) are sorted and named; their order comes from the names, by recursion
    where names repeat; the remaining suffixes are sorted by first symbol and the rank behind it and merged in.
    """
    n = len(s)
    if width >= DEPTH or n < 3:
        if n < 3 and width < DEPTH:
            return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
        return np.argsort(s, kind="stable")
    t = np.concatenate([s + 1, np.zeros(3, np.int64)])
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])  # a dummy keeps the halves apart
    n1 = len(np.arange(1, n + (n % 3 == 1), 3))
    bits = int(t.max()).bit_length()
    if 3 * bits <= 63:
        triple = (t[sample] << (2 * bits)) | (t[sample + 1] << bits) | t[sample + 2]
        kinds, names = np.unique(triple, return_inverse=True)
        count = len(kinds)
    else:
        by = np.lexsort((t[sample + 2], t[sample + 1], t[sample]))
        a = sample[by]
        new = np.concatenate([[0], (t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2])])
        names = np.empty(len(a), np.int64)
        names[by] = np.cumsum(new)
        count = int(names.max()) + 1
    sorted12 = sample[order(names, 3 * width)] if count < len(sample) else sample[np.argsort(names, kind="stable")]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted12] = np.arange(1, len(sorted12) + 1)
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    shift = len(sample) + 2
    zero = zero[np.argsort(t[zero] * shift + rank[zero + 1], kind="stable")]
    ones, twos = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    before1 = np.searchsorted(t[ones] * shift + rank[ones + 1], t[zero] * shift + rank[zero + 1])
    top = int(t.max()) + 1
    pair = np.unique(np.concatenate([t[twos] * top + t[twos + 1], t[zero] * top + t[zero + 1]]), return_inverse=True)[1] if len(twos) else np.zeros(len(zero), np.int64)
    before2 = np.searchsorted(pair[: len(twos)] * shift + rank[twos + 2], pair[len(twos) :] * shift + rank[zero + 2])
    place = np.maximum.accumulate(before1 + before2) + np.arange(len(zero))
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = zero
    out[rest] = sorted12
    return out


def prefix_classes(text: np.ndarray, starts: np.ndarray, length: int = DEPTH) -> np.ndarray:
    """A class number for each of ``starts``: equal where the ``length`` bytes from there are equal.

    text: uint8, and every start has ``length`` bytes behind it.  Suffixes are sorted, then adjacent prefixes compared.
    """
    wanted = np.full(len(text), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    by = order(text.astype(np.int64))
    by = by[wanted[by] >= 0]
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = padded[: len(text)].copy()
    for k in range(1, 8):
        words = (words << np.uint64(8)) | padded[k : len(text) + k]
    new = np.zeros(len(by), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        w = words[by + k]
        new[1:] |= w[1:] != w[:-1]
    out = np.empty(len(starts), np.int64)
    out[wanted[by]] = np.cumsum(new)
    return out
