"""Suffix arrays by Larsson-Sadakane refinement and Kasai's common prefixes, in numpy.

One shard's text is at most MOST symbols (bytes, or words known by 32 bits), so that two ranks and a place fit in 63 bits and
one sort of packed words refines all groups at once. A separator ends each part: the greatest symbol, which no text holds
(UTF-8 has no 0xFF).
"""

from __future__ import annotations

import numpy as np

#: Bits of a place in a shard; a shard holds fewer symbols than that.
BITS = 21
MOST = (1 << BITS) - 1


def separator(kind: np.dtype) -> int:
    return int(np.iinfo(kind).max)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order; what lies beyond the end counts as greater than any symbol.

    Suffixes are sorted by their first symbols and get ranks; then those that share a rank are sorted by the rank of the
    suffix h bytes on, which doubles the bytes that ranks stand for. Suffixes that are alone in their rank stay in place.
    """
    n = len(text)
    if n > MOST:
        raise ValueError(f"a shard holds {MOST} symbols at most")
    place = np.arange(n, dtype=np.uint64)
    # The first sort packs as many symbols as fit beside a place: five bytes, or two words by their ranks in the shard.
    first, bits = (5, 8) if text.dtype == np.uint8 else (2, BITS)
    symbols = text if text.dtype == np.uint8 else np.unique(text, return_inverse=True)[1].astype(np.uint64)
    padded = np.concatenate([symbols, np.full(first, 0xFF if bits == 8 else MOST, symbols.dtype)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(first):
        key = key << np.uint64(bits) | padded[k : k + n]
    packed = key << np.uint64(BITS) | place
    packed.sort()
    order = (packed & np.uint64(MOST)).astype(np.int64)
    heads = np.ones(n, dtype=bool)
    key = packed >> np.uint64(BITS)
    heads[1:] = key[1:] != key[:-1]
    rank = np.empty(n, dtype=np.int64)
    h = first
    while True:
        group = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        rank[order] = group
        alone = heads & np.append(heads[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        who = order[open_]
        ahead = who + h
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n)
        packed = (group[open_].astype(np.uint64) << np.uint64(2 * BITS)) | (after.astype(np.uint64) << np.uint64(BITS)) | who.astype(np.uint64)
        packed.sort()
        order[open_] = (packed & np.uint64(MOST)).astype(np.int64)
        key = packed >> np.uint64(BITS)
        heads[open_[0]] = True
        new = np.ones(len(open_), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        heads[open_] = new
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """For each place in order, the length (up to `most`) that its suffix shares with the one before it; the first has 0.

    Kasai's walk: the suffix one symbol on shares at least one symbol less with its own neighbour. The text is cut into lanes
    that walk in step.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    size = -(-n // lanes)
    padded = np.concatenate([text, np.full(most + 1, separator(text.dtype), text.dtype)])
    shared = np.zeros(n, dtype=np.int64)
    at = np.arange(0, n, size)
    stop = np.minimum(at + size, n)
    length = np.zeros(len(at), dtype=np.int64)
    while len(at):
        other = before[at]
        a, b = at + length, other + length
        same = (other >= 0) & (length < most) & (a < n) & (b < n)
        same &= padded[np.minimum(a, n)] == padded[np.minimum(np.maximum(b, 0), n)]
        settled = ~same
        shared[at[settled]] = np.where(other[settled] >= 0, length[settled], 0)
        length = np.where(same, length + 1, np.maximum(length - 1, 0))
        at = at + settled
        going = at < stop
        if not going.all():
            at, stop, length = at[going], stop[going], length[going]
    return shared[order]
