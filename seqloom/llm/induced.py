"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Levels whose buckets hold so many suffixes on average are induced a bucket at a time, others one suffix after the other.
LEAST_BUCKET = 64


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it (S-type); the last is."""
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(len(s), bool)
    out[:-1] = np.append(step, 1)[nxt] > 0
    return out


def induce(s: np.ndarray, is_s: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in order: larger types forward, then smaller ones backward.

    Within a bucket all suffixes that are already placed hand on their
    predecessors at once; a run of one symbol takes a round for each repeat.
    """
    n, sigma = len(s), int(s.max()) + 1
    size = np.bincount(s, minlength=sigma)
    tails = np.cumsum(size)
    heads = tails - size
    order = np.empty(n, np.int64)
    seeds = leftmost[np.argsort(s[leftmost], kind="stable")]
    seed_at = np.concatenate([[0], np.cumsum(np.bincount(s[leftmost], minlength=sigma))])

    def hand_on(block: np.ndarray, kind: bool, at: np.ndarray, sign: int) -> None:
        before = block[block > 0] - 1
        before = before[is_s[before] == kind]
        if not len(before):
            return
        symbol = s[before]
        by = np.argsort(symbol, kind="stable")
        symbol = symbol[by]
        many = np.bincount(symbol, minlength=sigma)
        rank = np.arange(len(symbol)) - (np.cumsum(many) - many)[symbol]
        order[at[symbol] + (rank if sign > 0 else -1 - rank)] = before[by]
        at += sign * many

    used = np.flatnonzero(size)
    at = heads.copy()
    for c in used:
        done = heads[c]
        while done < at[c]:
            block, done = order[done : at[c]], at[c]
            hand_on(block, False, at, 1)
        hand_on(seeds[seed_at[c] : seed_at[c + 1]], False, at, 1)
    larger, at = at, tails.copy()
    for c in used[::-1]:
        done = tails[c]
        while at[c] < done:
            block, done = order[at[c] : done][::-1], at[c]
            hand_on(block, True, at, -1)
        hand_on(order[heads[c] : larger[c]][::-1], True, at, -1)
    order[0] = n - 1
    return order


def induce_singly(s: np.ndarray, is_s: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """As ``induce``, one suffix after the other; the lists are read while they fill."""
    size = np.bincount(s)
    ends = np.cumsum(size)
    seeds = leftmost[np.argsort(s[leftmost], kind="stable")]
    count = np.bincount(s[leftmost], minlength=len(size))
    order = np.full(len(s), -1)
    order[np.arange(len(seeds)) + np.repeat(ends - np.cumsum(count), count)] = seeds
    # the symbol before each suffix, where that one's type is asked for; -1 also stands for no suffix (the last place)
    before, type_before = np.append(np.roll(s, 1).astype(np.int64), -1), np.append(np.roll(is_s, 1), False)
    before[0] = -1
    larger, smaller = np.where(type_before, -1, before).tolist(), np.where(type_before, before, -1).tolist()
    order, at = order.tolist(), (ends - size).tolist()
    for j in order:
        c = larger[j]
        if c >= 0:
            k = at[c]
            order[k] = j - 1
            at[c] = k + 1
    at = (ends - 1).tolist()
    for j in reversed(order):
        c = smaller[j]
        if c >= 0:
            k = at[c]
            order[k] = j - 1
            at[c] = k - 1
    order[0] = len(s) - 1
    return np.array(order, np.int64)


def substring_ranks(symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The number of smaller ones for each substring; a few symbols at a time, more as fewer are left that look equal."""
    rank, open_, at, step = np.zeros(len(start), np.int64), np.arange(len(start)), 0, 4
    while len(open_):
        places = np.arange(at, at + step)[:, None]
        inside = places < length[open_]
        columns = np.where(inside, symbols[np.where(inside, start[open_] + places, 0)], 0)
        by = np.lexsort([*columns[::-1], rank[open_]])
        open_, columns = open_[by], columns[:, by]
        old = rank[open_]
        fresh = np.append(True, old[1:] != old[:-1])
        new = fresh | np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0))
        place = np.arange(len(open_))
        rank[open_] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(fresh, place, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        at += step
        open_ = open_[tied & (length[open_] > at)]
        step = min(2 * step, max(4, (1 << 20) // max(1, len(open_))), 1024)
    return rank


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes in order; the last symbol is 0 and stands nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    s = s.astype(np.uint16 if s.max() < 1 << 16 else np.int64)
    sort = induce if LEAST_BUCKET * int(s.max()) < n else induce_singly
    is_s = smaller_than_next(s)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[1:] = is_s[1:] & ~is_s[:-1]
    leftmost = np.flatnonzero(is_leftmost)
    if len(leftmost) > 1:
        # names: equal substrings from one leftmost position to the next have one name
        length = np.diff(np.append(leftmost, n - 1)) + 1
        rank = substring_ranks(2 * s.astype(np.int64) + is_s + 1, leftmost, length)  # of equal symbols, the larger type is less
        by = np.argsort(rank, kind="stable")
        name = np.cumsum(np.diff(rank[by], prepend=-1) > 0) - 1
        if name[-1] + 1 == len(leftmost):
            leftmost = leftmost[by]
        else:
            reduced = np.empty(len(leftmost), np.int64)
            reduced[by] = name
            leftmost = leftmost[suffix_array(reduced)]
    return sort(s, is_s, leftmost)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix its predecessor in the order (-1: none) and the length of their common prefix, which ends before ``stop``.

    Where the symbols before two neighbours agree, the prefix is one shorter
    than that of the suffix before; only the others are compared, four symbols
    at a time.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    wide = np.concatenate([s.astype(np.uint64), np.zeros(4, np.uint64)])
    four = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)
    is_stop = np.concatenate([s == stop, np.ones(4, bool)])
    stop_ahead = np.concatenate([is_stop[:n] | is_stop[1 : n + 1] | is_stop[2 : n + 2] | is_stop[3 : n + 3], np.ones(4, bool)])
    at = np.arange(n)
    lead = np.ones(n, bool)
    ok = (before > 0) & (at > 0)
    lead[ok] = (s[at[ok] - 1] != s[before[ok] - 1]) | (s[at[ok] - 1] == stop)
    a = np.flatnonzero(lead & (before >= 0))
    common = np.zeros(n, np.int64)
    i, j, own = a.copy(), before[a], a
    while len(own):
        same = (i < n) & (j < n)
        same[same] = (four[i[same]] == four[j[same]]) & ~stop_ahead[i[same]]
        common[own[same]] += 4
        rest = own[~same]
        x, y = i[~same], j[~same]
        for _ in range(3):
            go = (x < n) & (y < n)
            go[go] = (s[x[go]] == s[y[go]]) & ~is_stop[x[go]]
            common[rest[go]] += 1
            rest, x, y = rest[go], x[go] + 1, y[go] + 1
        i, j, own = i[same] + 4, j[same] + 4, own[same]
    last = np.maximum.accumulate(np.where(lead, at, 0))
    return before, np.maximum(common[last] - (at - last), 0)
