"""Content-defined anchors: where equal windows of different texts are brought together."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 28


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of all substrings of some bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.total[1:])
        self.shift = powers(UNBASE, len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.shift[start])


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def owned(data: np.ndarray, offsets: np.ndarray, width: int, half: int, place_bits: int = PLACE_BITS) -> dict[str, np.ndarray]:
    """For each anchor of the texts its hash and the windows of ``width`` bytes that it owns.

    A window is owned by that substring of ``half`` bytes in it whose hash is least
    (the first of equals). So equal windows have equal anchors at equal places.
    An anchor's windows are neighbours: they start at ``first`` to ``last``
    (from the text's start), and together cover its region. ``kind`` is a hash
    of the region and of the anchor's place in it.
    """
    hashes = Hashes(data)
    n = len(data)
    if n < width:
        return {k: np.zeros(0, np.int64) for k in ("doc", "first", "last", "anchor", "kind")}
    low = np.uint64((1 << place_bits) - 1)
    owners = []
    for a in range(0, n - width + 1, max(1, (1 << place_bits) - width)):  # places fit their bits
        at = np.arange(a, min(n - half + 1, a + (1 << place_bits) - half))
        packed = (hashes.of(at, at + half) & ~low) | (at - a).astype(np.uint64)
        owners.append((least_in_window(packed, width - half + 1) & low).astype(np.int64) + a)
    owner = np.concatenate([o[: (1 << place_bits) - width] for o in owners])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(owner)]
    inside = np.flatnonzero(np.arange(len(owner)) + width <= offsets[doc + 1])
    owner, doc = owner[inside], doc[inside]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])])) if len(owner) else np.zeros(0, np.int64)
    first, last = inside[new], inside[np.append(new[1:], len(owner)) - 1] if len(new) else inside[new]
    anchor, doc = owner[new], doc[new]
    kind = hashes.of(first, last + width) ^ mixed(((anchor - first) << 16 | (last - first)).astype(np.uint64))
    start = offsets[doc]
    return {"doc": doc, "first": first - start, "last": last - start, "anchor": hashes.of(anchor, anchor + half).view(np.int64), "kind": kind.view(np.int64), "place": anchor - first}
