"""Simple-8b: ids in 64-bit words, whose upper four bits say how many share a word.

Values are coded in blocks of ``BLOCK``; the word at which each block starts is kept,
so blocks can be decoded alone and many are coded side by side in numpy.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the coding: selector -> (values in a word, bits of each). Selector 0 is the
#: escape, after which a word holds one value as it is; selector 1 stands for a run of zeros.
SELECTORS = {1: (120, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
BLOCK = 4096
_COUNT = np.array([1, *(n for n, _ in SELECTORS.values())], np.int64)
_SHIFT = np.uint64(60)
_LOW = np.uint64((1 << 60) - 1)


def _widths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    rest = values.copy()
    for by in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << by)
        out += np.uint8(by) * big
        rest = np.where(big, rest >> np.uint64(by), rest)
    return out + (rest > 0)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): offsets has the first word of each block, and the number of words."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    reach = 128
    held = np.zeros((blocks, BLOCK + reach), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    held[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # The widest of the next k values at each place, for k a power of two and then for each selector.
    doubled = {1: _widths(held)}
    k = 1
    while k < 64:
        wide = doubled[k].copy()
        np.maximum(wide[:, :-k], doubled[k][:, k:], out=wide[:, :-k])
        doubled[2 * k] = wide
        k *= 2
    best = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(15, 0, -1):
        count, bits = SELECTORS[s]
        p = 1 << (count.bit_length() - 1)
        wide = np.maximum(doubled[p][:, :BLOCK], doubled[p][:, count - p : count - p + BLOCK])
        best[wide <= bits] = s
    sizes = np.full(blocks, BLOCK, np.int64)
    sizes[-1] = n - (blocks - 1) * BLOCK
    row, at = np.arange(blocks), np.zeros(blocks, np.int64)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):
        sel = best[row, at]
        steps.append((row, at, sel))
        at = at + _COUNT[sel]
        live = at < sizes[row]
        row, at = row[live], at[live]
    row, at, sel = (np.concatenate(x) for x in zip(*steps))
    order = np.lexsort((at, row))
    row, at, sel = row[order], at[order], sel[order]
    place = np.cumsum(1 + (sel == 0)) - 1 - (sel == 0)
    words = np.zeros(int(place[-1]) + 1 + int(sel[-1] == 0), np.uint64)
    words[place] = sel.astype(np.uint64) << _SHIFT
    for s in range(2, 16):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            count, bits = SELECTORS[s]
            # Values past a block's end are zeros, which the reader leaves out.
            group = held[row[mine][:, None], at[mine][:, None] + np.arange(count)]
            words[place[mine]] |= np.bitwise_or.reduce(group << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    raw = np.flatnonzero(sel == 0)
    words[place[raw] + 1] = held[row[raw], at[raw]]
    offsets = np.append(place[np.searchsorted(row, np.arange(blocks))], len(words))
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of whole blocks. Blocks from i on: decode(words[offsets[i]:], offsets[i:] - offsets[i], ...)."""
    blocks = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> _SHIFT).astype(np.int64)
    # A word after an escape isn't a selector, whatever its upper bits say.
    for i in np.flatnonzero(sel == 0):
        if sel[i] == 0 and i + 1 < len(sel):
            sel[i + 1] = -1
    heads = np.flatnonzero(sel >= 0)
    kinds = sel[heads]
    counts = _COUNT[kinds]
    block = np.searchsorted(offsets[1:], heads, side="right")
    before = np.cumsum(counts) - counts
    first = before[np.searchsorted(heads, offsets[:-1])]
    at = before - first[block]
    out = np.zeros((blocks, BLOCK + 128), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(kinds == s)
        if len(mine):
            count, bits = SELECTORS[s]
            group = (words[heads[mine]][:, None] & _LOW) >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[block[mine][:, None], at[mine][:, None] + np.arange(count)] = group & np.uint64((1 << bits) - 1)
    raw = np.flatnonzero(kinds == 0)
    out[block[raw], at[raw]] = words[heads[raw] + 1]
    return out[:, :BLOCK].reshape(-1)[:n]
