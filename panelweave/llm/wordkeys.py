"""64-bit keys of the words of whole texts, for a batch of texts at a time.

A word is a run of bytes other than space and 0x09-0x0D. Its key is a tabulation
hash: one fixed random number per byte and place is summed and mixed. Two
different words share a key with probability 2**-64; among a billion distinct
words 0.03 such pairs are expected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PLACES = 64
_TABLE = np.random.default_rng(20240501).integers(0, 2**64, (PLACES, 256), dtype=np.uint64).ravel()
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Bytes whose arrays fit a processor's cache, and bytes searched at once for the next cut.
PIECE, AHEAD = 1 << 16, 1 << 10


def mix(keys: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers under which near inputs have far outputs."""
    keys = keys ^ (keys >> np.uint64(30))
    keys = keys * np.uint64(0xBF58476D1CE4E5B9)
    keys = keys ^ (keys >> np.uint64(27))
    keys = keys * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Key of an ordered pair of keys."""
    return mix(first * _STEP + mix(second + _STEP))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Keys of all runs of ``size`` words; of the whole sequence if it is shorter."""
    size = min(size, len(words))
    if size == 0:
        return words
    keys = words[: len(words) - size + 1]
    for place in range(1, size):
        keys = pair(keys, words[place : len(words) - size + 1 + place])
    return keys


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    filled = pa.concat_arrays([filled]) if isinstance(filled, pa.ChunkedArray) else filled
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[
        filled.offset : filled.offset + len(filled) + 1
    ]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _keys(data: np.ndarray, kept: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Keys of the words that start at ``first``, from the bytes where ``kept``."""
    inner = data[kept]
    start = np.cumsum(kept, dtype=np.int32)[first].astype(np.int64) - 1
    sizes = np.diff(start, append=len(inner))
    place = np.arange(len(inner))
    place -= np.repeat(start, sizes)
    long = sizes.max() >= PLACES
    turn = place >> 6 if long else None
    if long:
        place &= PLACES - 1
    place <<= 8
    place += inner
    parts = _TABLE.take(place)
    if long:
        parts *= (turn * 2 + 1).astype(np.uint64)
    return mix(np.add.reduceat(parts, start))


def word_keys(
    column: pa.Array, lower: bool = True, shapes: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """``(keys, ends, shape_keys)``: text ``i`` has the words ``ends[i]:ends[i + 1]``.

    NULL is the empty text; ``lower`` folds A-Z. ``shapes`` adds a second key per
    word from its outline: capitals, other letters and digits as one class each,
    everything else as it is, runs of one class as one.
    """
    data, offsets = _buffers(column)
    if lower:
        # Bytes below "A" wrap round.
        data = data + (data - np.uint8(ord("A")) < 26) * np.uint8(32)
    space = (data == 0x20) | (data - np.uint8(0x09) < 5)
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    keys, places, outlines = [], [], []
    at = 0
    while at < len(data):
        # Cut at a space or at the start of a text, so that no word is divided.
        to = min(at + PIECE, len(data))
        while to < len(data):
            stop = min(to + AHEAD, len(data))
            cuts = space[to:stop] | begins[to:stop]
            if cuts.any():
                to += int(cuts.argmax())
                break
            to = stop
        part, blank, new = data[at:to], space[at:to], begins[at:to]
        after = np.ones(to - at, bool)
        after[1:] = blank[:-1]
        first = np.flatnonzero(~blank & (after | new))
        if len(first):
            keys.append(_keys(part, ~blank, first))
            places.append(first + at)
            if shapes:
                outlines.append(_outlines(part, blank, first))
        at = to
    found = np.concatenate(places) if places else np.zeros(0, np.int64)
    nothing = np.zeros(0, np.uint64)
    return (
        np.concatenate(keys) if keys else nothing,
        np.searchsorted(found, offsets),
        (np.concatenate(outlines) if outlines else nothing) if shapes else None,
    )


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def _outlines(part: np.ndarray, blank: np.ndarray, first: np.ndarray) -> np.ndarray:
    kinds = _CLASS[part]
    changed = np.ones(len(kinds), bool)
    changed[1:] = kinds[1:] != kinds[:-1]
    changed[first] = True
    return _keys(kinds, changed & ~blank, first)
