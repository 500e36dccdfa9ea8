"""Merging of neighbouring symbols by rank, as byte-pair encodings define it."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from math import inf

import numpy as np

# Up to so many symbols the least rank is sought in a list, which is quicker than a heap.
_SHORT = 48


def _merge_short(symbols: list, rank: Callable) -> list:
    ranks = [inf if (r := rank(a + b)) is None else r for a, b in zip(symbols, symbols[1:])]
    while ranks and (least := min(ranks)) != inf:
        i = ranks.index(least)
        symbols[i] += symbols.pop(i + 1)
        del ranks[i]
        if i < len(ranks):
            ranks[i] = inf if (r := rank(symbols[i] + symbols[i + 1])) is None else r
        if i:
            ranks[i - 1] = inf if (r := rank(symbols[i - 1] + symbols[i])) is None else r
    return symbols


def merge(symbols: list, rank: Callable) -> list:
    """Merge the pair of lowest rank, leftmost among equals, until no pair has one.

    ``rank`` takes two joined symbols and gives their rank or None.  A heap and
    links between neighbours make this O(n log n), for pieces of any length.
    """
    symbols = list(symbols)
    n = len(symbols)
    if n <= _SHORT:
        return _merge_short(symbols, rank)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i] if symbols[i] is not None else n
        if j >= n or symbols[i] + symbols[j] != joined:
            continue
        symbols[i], symbols[j] = joined, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(joined + symbols[k])) is not None:
                heapq.heappush(heap, (r, i, joined + symbols[k]))
        if (h := before[i]) >= 0 and (r := rank(symbols[h] + joined)) is not None:
            heapq.heappush(heap, (r, h, symbols[h] + joined))
    return [s for s in symbols if s is not None]


class Pairs:
    """Ranks of pairs of symbols, for symbols that are numbers themselves: a symbol's number is the rank that its pair had."""

    NONE = np.int64(1 << 62)

    def __init__(self, ranks: dict[bytes, int]) -> None:
        made = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left = ranks.get(token[:k])
                if left is not None and (right := ranks.get(token[k:])) is not None:
                    made[left << 31 | right] = rank
        self._keys = np.array(sorted(made), np.int64)
        self._ranks = np.array([made[k] for k in self._keys.tolist()] + [self.NONE], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where it has none."""
        wanted = left << 31 | right
        at = np.searchsorted(self._keys, wanted)
        there = at < len(self._keys)
        there[there] = self._keys[at[there]] == wanted[there]
        return self._ranks[np.where(there, at, len(self._keys))]

    def merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge as ``merge`` does, in all rows (of one length) at once: the symbols left, and how many a row has."""
        out, sizes, open_rows = rows.copy(), np.full(len(rows), rows.shape[1]), np.arange(len(rows))
        ranks = self.rank(rows[:, :-1], rows[:, 1:])
        while rows.shape[1] > 1 and len(rows):
            least = ranks.argmin(1)  # the leftmost of equals
            found = ranks[np.arange(len(rows)), least]
            ended = found == self.NONE
            if ended.any():
                out[open_rows[ended], :rows.shape[1]], sizes[open_rows[ended]] = rows[ended], rows.shape[1]
                rows, ranks, least, found, open_rows = (x[~ended] for x in (rows, ranks, least, found, open_rows))
            n, width = rows.shape
            each = np.arange(n)
            rows[each, least] = found
            stays = np.ones((n, width), bool)
            stays[each, least + 1] = False
            rows = rows[stays].reshape(n, width - 1)
            # The pair merged goes; its neighbours are pairs with the new symbol.
            stays = np.ones((n, width - 1), bool)
            stays[each, least] = False
            ranks = ranks[stays].reshape(n, width - 2)
            after = least < width - 2
            ranks[each[after], least[after]] = self.rank(found[after], rows[each[after], least[after] + 1])
            before = least > 0
            ranks[each[before], least[before] - 1] = self.rank(rows[each[before], least[before] - 1], found[before])
        out[open_rows, :rows.shape[1]], sizes[open_rows] = rows, rows.shape[1]
        return out, sizes


class HashedPairs(Pairs):
    """``Pairs`` of a list of merges, whose symbols are numbered in the list's order.

    A pair is looked up by hash; pairs whose place is taken by another go to the
    next, smaller table.
    """

    def __init__(self, made: dict[tuple[int, int], int]) -> None:
        if list(made.values()) != sorted(set(made.values())):
            raise ValueError("a merge's symbol must have a larger number than those of the merges before it")
        keys, numbers = np.array([a << 31 | b for a, b in made], np.int64), np.array(list(made.values()), np.int64)
        self._tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        while len(keys):
            size = 1 << (len(keys).bit_length() + 3)
            places, shift = np.full(size, -1, np.int64), np.uint64(65 - size.bit_length())
            at = self._place(keys, shift)
            places[at] = keys
            held = places[at] == keys
            ranks = np.full(size, self.NONE, np.int64)
            ranks[at[held]] = numbers[held]
            self._tables.append((shift, places, ranks))
            keys, numbers = keys[~held], numbers[~held]

    @staticmethod
    def _place(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted, found = left << 31 | right, self.NONE
        for shift, places, ranks in self._tables:
            at = self._place(wanted, shift)
            found = np.where(places[at] == wanted, ranks[at], found)
        return np.broadcast_to(found, wanted.shape)
