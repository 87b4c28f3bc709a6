"""Hashes of words, for whole batches of texts at a time."""

from __future__ import annotations

import numpy as np

from ionloom.llm.common import blocks_of

STEP = 1 << 20  # bytes hashed at once
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _power_table(length: int) -> np.ndarray:
    powers = np.full(length, 0xD6E8FEB86659FD93, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    """A 64-bit value per byte; A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * PRIME)
    values[65:91] = values[97:123]
    return values


VALUES = byte_values()
POWERS = _power_table(1 << 12)


def white_space() -> np.ndarray:
    """Separators of the words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def not_alphanumeric() -> np.ndarray:
    """Separators of the lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    table = np.zeros(256, bool)
    table[:128] = True
    for first, last in ((48, 58), (65, 91), (97, 123)):
        table[first:last] = False
    return table


def _cuts(raw: np.ndarray, start: int, stop: int, apart: np.ndarray) -> list[int]:
    """Places between ``start`` and ``stop``, about a step from each other, where no word is cut."""
    places = [start]
    while stop - places[-1] > STEP:
        window = apart[raw[places[-1] : places[-1] + STEP]]
        last = np.flatnonzero(window[::-1][: STEP - 1])
        if len(last):
            places.append(places[-1] + STEP - int(last[0]))
            continue
        at = places[-1] + STEP
        while at < stop and not apart[raw[at]]:
            at += 1
        places.append(at)
    if places[-1] < stop:
        places.append(stop)
    return places


def _hash_step(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some rows that lie end to end, and the place where each begins."""
    global POWERS
    inside = ~apart[raw]
    begins = inside.copy()
    begins[1:] &= apart[raw[:-1]]
    rows = offsets[(offsets > 0) & (offsets < len(raw))]
    begins[rows] = inside[rows]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(len(raw)) - starts[np.maximum(np.cumsum(begins) - 1, 0)]
    place[: starts[0]] = 0
    place[~inside] = 0
    longest = int(place.max()) + 1
    if longest > len(POWERS):
        POWERS = _power_table(1 << longest.bit_length())
    values = VALUES[raw] * POWERS[place]
    values[~inside] = 0
    return mix(np.add.reduceat(values, starts)), starts


def hash_words(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every row (A-Z as a-z), and the n+1 bounds of the rows among them.

    ``apart`` marks the bytes that separate words. Long rows are hashed in steps; a word is never cut.
    """
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last in blocks_of(offsets, STEP):
        low, high = int(offsets[first]), int(offsets[last])
        places = [low, high] if last - first > 1 else _cuts(raw, low, high, apart)
        for start, stop in zip(places[:-1], places[1:], strict=True):
            found, starts = _hash_step(raw[start:stop], offsets[first : last + 1] - start, apart)
            hashes.append(found)
            owner = np.searchsorted(offsets[first + 1 : last + 1] - start, starts, "right")
            counts[first:last] += np.bincount(owner, minlength=last - first)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` consecutive words, order included."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    count = len(hashes) - length + 1
    total = np.zeros(count, np.uint64)
    for k in range(length):
        total = (total + hashes[k : k + count]) * PRIME
    return mix(total)


def shingles(hashes: np.ndarray, length: int) -> np.ndarray:
    """The sorted distinct runs of ``length`` words; fewer words make one run of all of them."""
    if not len(hashes):
        return hashes
    return np.unique(sequences(hashes, min(length, len(hashes))))
