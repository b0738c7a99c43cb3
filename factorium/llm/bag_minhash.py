"""Weighted MinHash by Poisson processes over discretised weights.

An element of weight w is a point set over (0, w]. The weights are cut into (0, 1], (1, 2], (2, 4], (4, 8], ...;
each interval carries its own Poisson process, whose points come in order of time and fall on a place of the
signature and on a level within the interval. A point counts if its level is within w, so an interval that w
covers in part is thinned, and elements of different weights share the points they have in common. The place of
the signature keeps its earliest time: two bags agree there with the probability of their weighted Jaccard
similarity. A process stops once it is later than every place's time, which makes the work n + m log m instead of n m.
"""

from __future__ import annotations

import numpy as np

GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def processes(bag: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bag, seed, rate, levels within) of the intervals that each element reaches."""
    out = [[], [], [], []]
    low, width, j = 0, 1, 0
    while len(bag):
        out[0].append(bag)
        out[1].append(mix(element + np.uint64((j + 1) * int(GOLD) % 2**64)))
        out[2].append(np.full(len(bag), width, dtype=np.int64))
        out[3].append(np.minimum(weight - low, width))
        low, width, j = low + width, max(1, low + width), j + 1
        more = weight > low
        bag, element, weight = bag[more], element[more], weight[more]
    return tuple(np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out)


def signatures(bags: int, bag: np.ndarray, element: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """A row of m times for each of `bags` bags; their elements are distinct within a bag, weights are whole. A bag without elements has infinite times."""
    times = np.full(bags * m, np.inf)
    owner, seed, rate, within = processes(bag, element, weight)
    at = np.zeros(len(owner))
    step = np.zeros(len(owner), dtype=np.uint64)
    # As many points at once as a process of an average bag needs; what goes beyond the last time changes nothing.
    block = int(np.clip(4 * m * bags // max(1, len(owner)), 1, 32))
    while len(owner):
        numbers = step[:, None] + np.arange(1, block + 1, dtype=np.uint64)
        drawn = mix(seed[:, None] + numbers * GOLD)
        gaps = -np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (rate[:, None] * m)
        gaps[:, 0] += at  # added one by one in order, so that the blocks' sizes leave no trace in the rounding
        points = np.cumsum(gaps, axis=1)
        second = mix(drawn ^ GOLD)
        place = owner[:, None] * m + (second % np.uint64(m)).astype(np.int64)
        thin = rate > within
        counts = np.ones(points.shape, dtype=bool)
        if thin.any():
            counts[thin] = ((second[thin] >> np.uint64(32)) % rate[thin, None].astype(np.uint64)).astype(np.int64) < within[thin, None]
        np.minimum.at(times, place[counts], points[counts])
        at, step = points[:, -1], numbers[:, -1]
        live = at < times.reshape(bags, m).max(axis=1)[owner]
        owner, seed, rate, within, at, step = (x[live] for x in (owner, seed, rate, within, at, step))
        block = min(64, block * 2)
    return times.reshape(bags, m)


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    # Rounded, so that machines whose logarithms differ in the last bit still agree.
    x = np.ascontiguousarray(times[:, : bands * rows].astype(np.float32)).view(np.uint32).astype(np.uint64).reshape(len(times), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, x.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * np.uint64(31) + x[:, :, i])
    return key.view(np.int64)
