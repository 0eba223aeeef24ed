"""Weighted MinHash signatures of documents by throwing darts (DartMinHash).

A document is its set of five-word shingles (a shorter one is a single shingle of all its words); a shingle that
stands there c times weighs 1 + ln c. Every shingle has the same infinite strip of darts in all documents: a Poisson
process of rate 1 over weight and rank, cut into areas (layers of weight by dyadic ranges of rank) whose numbers of
darts, and the darts themselves, come from hashes of shingle, area and number. Each dart aims at one of K coordinates.
A document is hit by the darts below its shingles' weights; per coordinate the hit of least rank is kept. Two
documents agree in a coordinate with the probability of their weighted Jaccard similarity.

Only darts of rank under (K ln K + 2 K) / total weight are thrown, about K ln K + 2 K for a document of any length; a
document that leaves a coordinate empty is thrown at again up to twice the rank.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from .common import words_of

WORDS, K, BANDS = 5, 128, 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Weights up to 32 (1 + ln c) in layers: 0 to 1, 1 to 2, 2 to 4 and so on.
_LAYERS = [(0.0, 1.0), (1.0, 1.0), (2.0, 2.0), (4.0, 4.0), (8.0, 8.0), (16.0, 16.0)]
#: Ranges of rank, for a layer of height 1.
_RANKS = [0.0, 1 / 256, 1 / 64, 1 / 16, 1 / 4, *(float(1 << k) for k in range(40))]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's output function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


_poisson: dict[float, np.ndarray] = {}


def _poisson_cdf(mean: float) -> np.ndarray:
    if mean not in _poisson:
        top = int(mean + 12 * mean**0.5 + 24)
        logs = np.arange(top) * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(np.arange(1, top)))])
        _poisson[mean] = np.cumsum(np.exp(logs))
    return _poisson[mean]


def shingles(texts: list[str | None], k: int = WORDS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Per text: its distinct shingles' hashes in order, their counts, and a hash of all its words in turn (0: none)."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((ids[w] for own in words for w in own), np.int64, int(lengths.sum()))
    hashed = np.fromiter(map(xxh3_64_intdigest, ids), np.uint64, len(ids))
    h = np.concatenate([hashed[flat], np.zeros(k, np.uint64)]) if len(flat) else np.zeros(k, np.uint64)
    n = len(flat)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = mix(rolled * np.uint64(3) + h[j : n + j] + _GOLDEN)
    out, at = [], 0
    for own, length in zip(words, lengths.tolist(), strict=True):
        if length >= k:
            s, c = np.unique(rolled[at : at + length - k + 1], return_counts=True)
        elif length:
            s, c = np.array([xxh3_64_intdigest(b" ".join(own))], np.uint64), np.ones(1, np.int64)
        else:
            s, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out.append((s, c, xxh3_128_digest(b" ".join(own)) if length else b""))
        at += length
    return out


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def _throw(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, reach: np.ndarray, k: int, best: np.ndarray, sign: np.ndarray) -> None:
    """Throws all darts of rank under reach[doc]; best and sign hold least rank and dart of each (document, coordinate)."""
    limit = reach[doc]
    found = []
    for layer, (low, height) in enumerate(_LAYERS):
        of = np.flatnonzero(weight > low)
        if not len(of):
            break
        for cell in range(len(_RANKS) - 1):
            start, end = _RANKS[cell] / height, _RANKS[cell + 1] / height
            of = of[limit[of] > start]
            if not len(of):
                break
            area = mix(element[of] + np.uint64((layer * 64 + cell + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            number = np.searchsorted(_poisson_cdf((end - start) * height), uniform(area), "right")
            hit = number > 0
            own = np.repeat(of[hit], number[hit])
            if not len(own):
                continue
            first = np.cumsum(number[hit]) - number[hit]
            turn = (np.arange(len(own)) - np.repeat(first, number[hit])).astype(np.uint64)
            dart = mix(np.repeat(area[hit], number[hit]) + (turn + np.uint64(1)) * _GOLDEN)
            rank = start + (end - start) * uniform(mix(dart + np.uint64(1)))
            good = (low + height * uniform(mix(dart + np.uint64(2))) < weight[own]) & (rank < limit[own])
            own, dart, rank = own[good], dart[good], rank[good]
            found.append((doc[own] * k + (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64), rank, dart))
    if found:
        place, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        np.minimum.at(best, place, rank)
        first = rank == best[place]
        sign[place[first]] = dart[first]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> np.ndarray:
    """(documents, k) darts of weighted sets (elements, weights); a row of zeros for an empty set."""
    n = len(sets)
    best, sign = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    size = np.array([len(s) for s, _ in sets], np.int64)
    if not size.sum():
        return sign.reshape(n, k)
    element, weight = np.concatenate([s for s, _ in sets]), np.concatenate([w for _, w in sets])
    doc = np.repeat(np.arange(n), size)
    total = np.bincount(doc, weights=weight, minlength=n)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    todo = size > 0
    while todo.any():
        own = todo[doc]
        _throw(element[own], weight[own], doc[own], reach, k, best, sign)
        todo &= np.isinf(best.reshape(n, k)).any(1)
        reach = reach * 2
    return sign.reshape(n, k)


def bands(signs: np.ndarray, number: int = BANDS) -> np.ndarray:
    """(documents, number) hashes of equal shares of the coordinates, different for each band."""
    n, k = signs.shape
    rows = signs.reshape(n, number, k // number)
    out = np.broadcast_to(np.arange(1, number + 1, dtype=np.uint64) * _GOLDEN, (n, number)).copy()
    for j in range(rows.shape[2]):
        out = mix(out * np.uint64(5) + rows[:, :, j])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Jaccard similarity of two documents' shingles (hashes in order, counts): weighted, and of the plain sets."""
    (s, c), (t, d) = a, b
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    both = t[at] == s
    wa, wb = weights(c), weights(d)
    common = np.minimum(wa[both], wb[at[both]]).sum()
    n = int(both.sum())
    return float(common / (wa.sum() + wb.sum() - common)), n / (len(s) + len(t) - n)
