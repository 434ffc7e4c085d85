"""Numpy kernels of the repeated-substring operator.

A text's *suffix buckets* are kept at sampled offsets only.  Every window of LENGTH bytes
contains Q-grams at LENGTH - Q + 1 offsets, and its *anchor* is the one whose bucket
identifier is least (the leftmost of equals).  Equal windows have the same anchor at the
same place, so only suffixes at anchors need buckets, about one in thirty.

Bucket identifiers are content hashes of 64 bits, so all tasks agree on them without
exchanging a numbering; that of a longer prefix is made from identifiers at later
offsets (ids of depth 2h at i from those of depth h at i and i + h).
"""

from __future__ import annotations

import numpy as np

LENGTH, Q = 100, 25
#: STEP windows in a row share the CORE bytes in their middle.
STEP = 8
CORE = LENGTH - STEP + 1
WIDTH = LENGTH - Q + 1
_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C55, np.uint64(0xBF58476D1CE4E5B9)
_AT = np.uint64((1 << 20) - 1)  # low bits that hold an anchor's place
#: Bytes of a kernel call; places must fit in _AT.
SLICE = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        most = SLICE + 4 * LENGTH
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(most, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Prefixes:
    """Hashes of any substring of a slice, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def fixed(self, n: int) -> np.ndarray:
        """Identifier of the n-gram at each offset."""
        last = len(self.sums) - n
        return _mixed((self.sums[n:] - self.sums[:last]) * self.down[:last])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def deepen(ids: np.ndarray, depth: int, to: int) -> np.ndarray:
    """Identifiers of prefixes of `to` bytes from those of `depth` bytes: each is refined by
    the identifiers at later offsets, and each refinement is used by the next."""
    while depth < to:
        step = min(depth, to - depth)  # the later part may overlap the first
        ids = _mixed(ids[: len(ids) - step] * _MIX + (ids[step:] ^ (ids[step:] >> np.uint64(17))))
        depth += step
    return ids


def core_ids(pre: Prefixes) -> np.ndarray:
    """Identifier of the CORE bytes at each offset."""
    return deepen(pre.fixed(Q), Q, CORE)


def contexts(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The STEP - 1 bytes before each core and those after it, as numbers; 0 beyond the text."""
    out = []
    for shift in (1 - STEP, CORE):
        where = at[:, None] + np.arange(shift, shift + STEP - 1)
        got = np.zeros((len(at), 8), np.uint8)
        got[:, : STEP - 1] = np.where((where >= 0) & (where < len(text)), text[np.clip(where, 0, len(text) - 1)], 0)
        out.append(got.view(np.uint64).ravel())
    return out[0], out[1]


def window_ids(core: np.ndarray, left: np.ndarray, right: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Identifier of the window that starts i bytes before its core: the core's, refined by i bytes on
    the left and STEP - 1 - i on the right."""
    i = i.astype(np.uint64)
    bits, all_bits = np.uint64(8), np.uint64(8 * (STEP - 1))
    left = (left >> (all_bits - bits * i)) | (i << np.uint64(60))
    right = np.where(i == np.uint64(0), right, right & ((np.uint64(1) << (all_bits - bits * i)) - np.uint64(1)))
    return _mixed(_mixed(core * _MIX + left) * _MIX + right)


def anchor_ranges(data: np.ndarray, bounds: np.ndarray):
    """The windows of the texts data[bounds[i]:bounds[i+1]], as runs that share an anchor.

    Returns (bucket of the anchor, identifier of the run's whole span, text, first
    window's offset in data, number of windows, bytes from there to the anchor)."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    if len(data) < LENGTH:
        return none
    pre = Prefixes(data)
    grams = pre.fixed(Q)
    least = (grams & ~_AT) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= WIDTH:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < WIDTH:
        least = np.minimum(least[: len(least) - (WIDTH - width)], least[WIDTH - width :])
    anchor = (least & _AT).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int8)
    begin, stop = bounds[:-1], bounds[1:] - LENGTH + 1
    own = np.flatnonzero(stop > begin)
    if not len(own):
        return none
    inside[begin[own]] += 1
    inside[stop[own]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first[begin[own]] = True
    lo = np.flatnonzero(first)
    end = np.append(lo[1:], len(anchor))
    text = np.searchsorted(bounds, lo, side="right") - 1
    n = np.minimum(end, stop[text]) - lo
    span = pre.spans(lo, lo + n + LENGTH - 1) ^ ((anchor[lo] - lo).astype(np.uint64) * np.uint64(_BASE)) ^ (n.astype(np.uint64) << np.uint64(55))
    return grams[anchor[lo]], span, text, lo, n, anchor[lo] - lo


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Unions of spans that touch, by document; spans of one document must end in the order they start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def not_first(bucket: np.ndarray, ids: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Sort each bucket by identifier, then place: (order, members that have an earlier equal, first of each refined bucket)."""
    order = np.lexsort((start, doc, ids, bucket))
    b, i, d, s = bucket[order], ids[order], doc[order], start[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
    late = (d != d[head]) | (s != s[head])
    return order, late, new


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in a span."""
    if not len(starts):
        return np.zeros(n, bool)
    step = np.bincount(np.clip(starts, 0, n), minlength=n + 1) - np.bincount(np.clip(ends, 0, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0
