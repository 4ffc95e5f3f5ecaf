"""Byte-pair merges over many words at once, as rounds of numpy operations on one flat symbol array.

Each round finds the smallest pair rank of every word by a segmented minimum, merges its leftmost
occurrence in all words at the same time, and compacts the arrays; it ends when no word has a known pair.
Within one word this is the textbook order (smallest rank first, then leftmost), so results equal the
sequential algorithm. Several occurrences of a word's smallest pair merge in the same round where no
pair made by these merges could have come before them.

A word that is still alive after ROUNDS rounds (a long run of signs whose pairs all have one rank, an unbroken text) is finished
with a queue of its pairs, in the same order and in n log n steps, since rounds that merge one pair each would be quadratic.
"""

import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
ROUNDS = 64


class PairTable:
    """(left id, right id) -> (rank, merged id) in an open-addressing table that numpy can probe."""

    def __init__(self, left, right, rank, merged):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        key = (left << 32) | right
        bits = max(4, int(len(key) * 4).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        self._dict = None
        todo, slot, self.probes = np.arange(len(key)), self._slot(key), 1
        while len(todo):
            free = self.key[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            at = slot[first]
            self.key[at], self.rank[at], self.merged[at] = key[todo[first]], np.asarray(rank)[todo[first]], np.asarray(merged)[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def as_dict(self) -> dict[int, tuple[int, int]]:
        """(left << 32 | right) -> (rank, merged id), made when it is first needed."""
        if self._dict is None:
            at = np.flatnonzero(self.key >= 0)
            self._dict = dict(zip(self.key[at].tolist(), zip(self.rank[at].tolist(), self.merged[at].tolist(), strict=True), strict=True))
        return self._dict

    def find(self, left, right):
        """Ranks (NONE: no such pair) and slots, whose merged ids are self.merged[slot]."""
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        rank = np.where(self.key[slot] == key, self.rank[slot], NONE)
        open_ = np.flatnonzero((self.key[slot] != key) & (self.key[slot] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.key[slot[open_]]
            hit = held == key[open_]
            rank[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return rank, slot


def merge_queue(symbols: list[int], pairs: PairTable) -> list[int]:
    """Merges one word, smallest rank first, then leftmost."""
    known, sym, n = pairs.as_dict(), list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(known[k][0], i, k) for i in range(n - 1) if (k := sym[i] << 32 | sym[i + 1]) in known]
    heapq.heapify(queue)
    while queue:
        _, i, k = heapq.heappop(queue)
        j = after[i] if sym[i] >= 0 else n
        if j >= n or sym[i] << 32 | sym[j] != k:
            continue
        sym[i], sym[j] = known[k][1], -1
        after[i] = j = after[j]
        if j < n:
            before[j] = i
            if (k := sym[i] << 32 | sym[j]) in known:
                heapq.heappush(queue, (known[k][0], i, k))
        if (h := before[i]) >= 0 and (k := sym[h] << 32 | sym[i]) in known:
            heapq.heappush(queue, (known[k][0], h, k))
    return [x for x in sym if x >= 0]


def merge_words(symbols: np.ndarray, sizes: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merges the words that lie one after another in `symbols`; returns all ids and each word's number."""
    total = len(sizes)
    sizes = sizes.astype(np.int64)
    sym, alive = symbols.astype(np.int32), np.flatnonzero(sizes)
    size = sizes[alive]
    done: list[tuple] = []
    queued: list[tuple] = []
    if len(sym):
        rank = np.full(len(sym), NONE, np.int32)
        slot = np.zeros(len(sym), np.int64)
        ends = np.cumsum(size) - 1
        inner = np.ones(len(sym), bool)
        inner[ends] = False
        at = np.flatnonzero(inner)
        rank[at], slot[at] = pairs.find(sym[at], sym[at + 1])
    rounds = 0
    while len(alive):
        if rounds == ROUNDS:
            for i, end in zip(alive.tolist(), np.cumsum(size).tolist(), strict=True):
                ids = np.array(merge_queue(sym[end - size[len(queued)] : end].tolist(), pairs), np.int32)
                queued.append(([i], [len(ids)], ids))
            done.extend(queued)
            break
        rounds += 1
        starts = np.cumsum(size) - size
        best = np.minimum.reduceat(rank, starts)
        over = best == NONE
        if over.all() or size[over].sum() * 2 >= len(sym):
            out = np.repeat(over, size)
            done.append((alive[over], size[over], sym[out]))
            keep = ~out
            sym, rank, slot = sym[keep], rank[keep], slot[keep]
            alive, size, best = alive[~over], size[~over], best[~over]
            if not len(alive):
                break
            starts = np.cumsum(size) - size
        word = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero((rank == best[word]) & (rank != NONE))
        at = _chosen(at, word, sym, rank, slot, best, pairs)
        sym[at] = pairs.merged[slot[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        size = size - np.bincount(word[at], minlength=len(size))
        moved = np.cumsum(keep) - 1
        sym, rank, slot, word = sym[keep], rank[keep], slot[keep], word[keep]
        here = moved[at]
        fresh = np.concatenate([here, here[here > 0] - 1])
        last = np.cumsum(size) - 1
        rank[fresh] = NONE
        fresh = fresh[(fresh != last[word[fresh]])]
        rank[fresh], slot[fresh] = pairs.find(sym[fresh], sym[fresh + 1])
    if not done:
        return np.zeros(0, np.int32), np.zeros(total, np.int64)
    words, counts = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    flat = np.concatenate([d[2] for d in done])
    number = np.zeros(total, np.int64)
    number[words] = counts
    begin = np.cumsum(number) - number
    from_ = np.cumsum(counts) - counts
    result = np.empty(len(flat), np.int32)
    result[np.arange(len(flat)) + np.repeat(begin[words] - from_, counts)] = flat
    return result, number


def _chosen(at, word, sym, rank, slot, best, pairs):
    """Of all places of smallest rank: the leftmost of each word, or all that may merge together."""
    w = word[at]
    first = np.ones(len(at), bool)
    first[1:] = w[1:] != w[:-1]
    if first.all():
        return at
    # in a run of overlapping places only every second one can merge
    head = first.copy()
    head[1:] |= at[1:] != at[:-1] + 1
    run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    at, first = at[even := (np.arange(len(at)) - run) % 2 == 0], first[even]
    w = word[at]
    made = pairs.merged[slot[at]]
    n = len(sym)
    after = sym.copy()
    gone = np.zeros(n, bool)
    after[at], gone[at + 1] = made, True
    left = at - 1
    left = np.where((left >= 0) & gone[np.maximum(left, 0)], left - 1, left)
    has_left = (left >= 0) & (word[np.maximum(left, 0)] == w)
    right = at + 2
    has_right = (right < n) & (word[np.minimum(right, n - 1)] == w)
    early = np.zeros(len(at), bool)
    early[has_left] = pairs.find(after[left[has_left]], made[has_left])[0] <= best[w[has_left]]
    early[has_right] |= pairs.find(made[has_right], sym[right[has_right]])[0] <= best[w[has_right]]
    unsafe = np.zeros(len(best), bool)
    unsafe[w[early]] = True
    return at[first | ~unsafe[w]]
