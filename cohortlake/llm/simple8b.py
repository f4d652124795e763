"""Word-aligned integer coding: a 4-bit selector and 60 payload bits in each 64-bit word.

Blocks of ``BLOCK`` values are coded independently and their word offsets are kept, so coding and
decoding advance over all blocks of a segment at once with array operations.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# Fixed values of the format: selector -> values in a word; their width is 60 // count bits.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
# Selector 0 is the escape: the next word holds one value of more than 60 bits as it is.
ESCAPE = 0

_LIMITS = np.array([1 << (60 // n) for n in COUNTS[1:]], dtype=np.uint64)
_ROOM = np.array([*COUNTS[1:], 1], dtype=np.uint8)
# Width class of each value of up to 16 bits, which most token ids are.
_CLASS = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
_SELECTOR = np.zeros(61, dtype=np.uint64)
_SELECTOR[list(COUNTS[1:])] = np.arange(1, len(COUNTS))


def _class_of(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < len(_CLASS):
        return _CLASS[values]
    return np.searchsorted(_LIMITS, values, side="right")


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, word offset of each block, number of escapes) of unsigned integers below 2**64.

    No values give no words and no offsets.
    """
    values = np.ascontiguousarray(values, dtype=np.uint64)
    total = len(values)
    blocks = -(-total // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    # Zeros behind each block fit any width, so a block's last word may be padded.
    padded = np.zeros((blocks, BLOCK + 60), dtype=np.uint64)
    full = total // BLOCK
    padded[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    padded[full:, : total - full * BLOCK] = values[full * BLOCK :]
    width_class = _class_of(padded.reshape(-1))
    escaped = (width_class == len(_LIMITS)).reshape(padded.shape)
    # room[i]: values of a word that starts at i. A window of n fits if its least room is n or more.
    least = _ROOM[width_class].reshape(padded.shape)
    room, covered = np.ones(padded.shape, dtype=np.uint8), 1
    for n in COUNTS[-2:0:-1]:
        shifted = least[:, n - covered :]
        least = np.minimum(least[:, : shifted.shape[1]], shifted)
        covered = n
        fits = least >= n
        if not fits.any():
            break
        room[:, : fits.shape[1]][fits] = n
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = total - (blocks - 1) * BLOCK
    at, used = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    active = np.arange(blocks)
    starts, owners, slots, counts = [], [], [], []
    while len(active):
        here = at[active]
        n = room[active, here].astype(np.int64)
        starts.append(here), owners.append(active), slots.append(used[active]), counts.append(n)
        used[active] += 1 + escaped[active, here]
        at[active] += n
        active = active[at[active] < sizes[active]]
    offsets = np.cumsum(used) - used
    start, owner, count = np.concatenate(starts), np.concatenate(owners), np.concatenate(counts)
    place = offsets[owner] + np.concatenate(slots)
    words = np.zeros(int(used.sum()), dtype=np.uint64)
    flat, first = padded.reshape(-1), owner * (BLOCK + 60) + start
    raw = escaped[owner, start]
    words[place[raw] + 1] = flat[first[raw]]
    for n in COUNTS[1:]:
        rows = np.nonzero((count == n) & ~raw)[0]
        if len(rows):
            word = np.full(len(rows), _SELECTOR[n] << np.uint64(60), dtype=np.uint64)
            for k in range(n):
                word |= flat[first[rows] + k] << np.uint64(k * (60 // n))
            words[place[rows]] = word
    return words, offsets, int(raw.sum())


def decode(words: np.ndarray, offsets: np.ndarray, total: int, escapes: int) -> np.ndarray:
    """The ``total`` values of ``encode``."""
    out = np.zeros(total, dtype=np.uint64)
    if not total:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    value_count = np.array([*COUNTS, 0])[selector]  # 15 is met only as the top of an escaped value
    if escapes:
        # The word behind an escape is a value, whatever its upper bits say.
        at = 0
        marks = np.nonzero(selector == ESCAPE)[0]
        for mark in marks:
            if mark >= at:
                value_count[mark], value_count[mark + 1] = 1, 0
                selector[mark], selector[mark + 1] = -1, -2
                at = mark + 2
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    before = np.cumsum(value_count) - value_count
    start = before - before[offsets][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, total)
    for s in np.unique(selector):
        rows = np.nonzero(selector == s)[0]
        if s == -1:
            out[start[rows]] = words[rows + 1]
        elif s > 0:
            n = COUNTS[s]
            bits = 60 // n
            mask = np.uint64((1 << bits) - 1)
            for k in range(n):
                inside = rows[start[rows] + k < end[rows]]
                out[start[inside] + k] = (words[inside] >> np.uint64(k * bits)) & mask
    return out
