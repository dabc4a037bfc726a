"""Merging of adjacent symbols, many rows at once.

The agenda of a matrix of symbols is a second matrix: the ranks of adjacent pairs, looked up
in a hash table of pairs. Each round takes the pair of the least rank off every row's agenda,
the leftmost of equal ones, merges it and puts the new symbol's pairs on it; rows are
compacted, and rows without a pair leave. Further pairs of that same rank are merged in the
same round where no other pair would come in between, which is looked up, so the result is
that of merging one by one. Ranks may have ties between different pairs (``tier``). A row of
more than ``LONG`` symbols has an agenda of its own, a heap, whose time does not grow with
the square of its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a matrix, and symbols of its longest row.
CELLS, LONG = 1 << 20, 2048
NONE, PAD = np.int32(2**31 - 1), np.int32(-1)
SLICE_ROWS, SLICE_CHARS = 256, 2_000_000


class PairTable:
    """Ranks of pairs of symbols in a hash table with open addressing, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(8, int(4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot = self.slots(keys)
        while len(keys):
            free = self.key[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.key[slot[put]], self.rank[slot[put]] = keys[put], rank[put]
            keys, rank, slot = keys[~put], rank[~put], slot[~put] + 1 & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE for pairs that merge into no symbol, and beside padding."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slot = self.slots(keys)
        found, open_ = np.full(keys.shape, NONE, np.int32), np.flatnonzero((left >= 0) & (right >= 0))
        while len(open_):
            at = slot[open_]
            there = self.key[at]
            same = there == keys[open_]
            found[open_[same]] = self.rank[at[same]]
            open_ = open_[~same & (there != -1)]
            slot[open_] = slot[open_] + 1 & self.mask
        return found


class Merger:
    """Merges by a table of (left, right, rank); the merged symbol's number is the pair's rank. tier: the rank that counts, where different pairs are equal."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, tier: np.ndarray | None = None):
        self.pairs, self.tier = PairTable(left, right, rank), tier
        self.found = left, right, rank
        self.alone: dict[tuple[int, int], int] | None = None
        #: Symbols with which a pair that comes before them, or beside them, can come about.
        self.restless = np.zeros(int(max(left.max(), right.max(), rank.max())) + 1, bool)
        for part in (left, right):
            made = part < (len(tier) if tier is not None else len(self.restless))
            self.restless[part[made][self.level(part[made]) >= self.level(rank[made])]] = True

    def level(self, rank: np.ndarray) -> np.ndarray:
        return rank if self.tier is None else np.where(rank == NONE, NONE, self.tier[np.minimum(rank, len(self.tier) - 1)])

    def merged(self, symbols: np.ndarray, size: np.ndarray, tiers: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """What is left of each row, one row after the other, and the rows' sizes; symbols: of all rows alike.

        Rows share a matrix: they should be of similar length. tiers: whether pairs that are
        equal by tier can occur.
        """
        if len(size) == 1 and size[0] > LONG:
            alone = np.array(self.merged_alone(symbols), np.int32)
            return alone, np.array([len(alone)])
        level_of = self.level if tiers else lambda rank: rank
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        own = np.arange(len(size))
        ids = np.full((len(size), size.max()), PAD, np.int32)
        ids[np.arange(ids.shape[1]) < size[:, None]] = symbols
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(size), -1)
        while len(own):
            level = level_of(rank)
            least = level.min(axis=1)
            live = least < NONE
            if not live.all():
                out = ids[~live]
                done.append((own[~live], size[~live], out[np.arange(out.shape[1]) < size[~live][:, None]]))
                own, size, ids, rank, least, level = own[live], size[live], ids[live], rank[live], least[live], level[live]
                if not len(own):
                    break
            hit = self.chosen(level == least[:, None], least, ids, rank, level_of)
            ids = np.where(hit, rank, ids)
            keep = np.arange(ids.shape[1]) < size[:, None]
            keep[:, 1:] &= ~hit[:, :-1]
            size = keep.sum(axis=1)
            place = np.arange(size.max()) < size[:, None]
            new, ranks, touched = np.full(place.shape, PAD, np.int32), np.full(place.shape, NONE, np.int32), np.zeros(place.shape, bool)
            new[place], ranks[place], touched[place] = ids[keep], rank[keep], hit[keep]
            touched[:, :-1] |= touched[:, 1:]
            row, at = np.nonzero(touched)
            right = np.where(at + 1 < new.shape[1], new[row, np.minimum(at + 1, new.shape[1] - 1)], PAD)
            ranks[row, at] = self.pairs(new[row, at], right)
            ids, rank = new, ranks
        return in_order(*(np.concatenate(x) for x in zip(*done, strict=True)))

    def chosen(self, hit: np.ndarray, least: np.ndarray, ids: np.ndarray, rank: np.ndarray, level_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Of a row's pairs of the least rank those merged in this round: from the left all that overlap no chosen one.

        Only the leftmost where merging one by one would meet a pair of lower or equal rank
        beside a new symbol: with what then stands before it, or with the symbol behind it.
        """
        if (hit[:, 1:] & hit[:, :-1]).any():
            at = np.arange(hit.shape[1])
            hit &= (at - np.maximum.accumulate(np.where(hit, -1, at), axis=1)) % 2 == 1
        row, at = np.nonzero(hit)
        unsure = self.restless[rank[row, at]]
        row, at = row[unsure], at[unsure]
        if len(row):
            new, last = rank[row, at], ids.shape[1] - 1
            behind = np.where(at + 2 <= last, ids[row, np.minimum(at + 2, last)], PAD)
            before = np.where((at > 1) & hit[row, at - 2], rank[row, at - 2], np.where(at > 0, ids[row, at - 1], PAD))
            early = (level_of(self.pairs(new, behind)) <= least[row]) | (level_of(self.pairs(before, new)) <= least[row])
            single = np.unique(row[early])
            first = hit[single].argmax(axis=1)
            hit[single] = False
            hit[single, first] = True
        return hit

    def merged_alone(self, row: np.ndarray) -> tuple[int, ...]:
        """One row by a heap of (rank, place): the same merges in the same order."""
        if self.alone is None:
            left, right, rank = (x.tolist() for x in self.found)
            self.alone = dict(zip(zip(left, right, strict=True), rank, strict=True))
        pairs, tier = self.alone, self.tier if self.tier is None else self.tier.tolist()
        level = (lambda r: r) if tier is None else tier.__getitem__
        symbols, n = row.tolist(), len(row)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(level(r), i, r, symbols[i], symbols[i + 1]) for i, r in enumerate(self.pairs(row[:-1], row[1:]).tolist()) if r != NONE]
        heapq.heapify(agenda)
        while agenda:
            _, a, rank, x, y = heapq.heappop(agenda)
            b = after[a]
            # a pair of which one side has been merged since is out of date
            if b >= n or symbols[a] != x or symbols[b] != y:
                continue
            symbols[a], symbols[b], after[a] = rank, -1, after[b]
            if after[a] < n:
                before[after[a]] = a
            for i, j in ((before[a], a), (a, after[a])):
                if i >= 0 and j < n and (r := pairs.get((symbols[i], symbols[j]))) is not None:
                    heapq.heappush(agenda, (level(r), i, r, symbols[i], symbols[j]))
        return tuple(x for x in symbols if x >= 0)

    def buckets(self, sizes: list[int]) -> Iterator[tuple[int, int]]:
        """Bounds of matrices over rows sorted by length: at most a quarter padding and CELLS cells; a long row is alone."""
        ordered, start = np.array(sizes), 0
        while start < len(sizes):
            if sizes[start] > LONG:
                stop = start + 1
            else:
                longest = min(max(sizes[start] * 4 // 3, 4), LONG)
                stop = min(int(np.searchsorted(ordered, longest, "right")), start + max(1, CELLS // longest))
            yield start, stop
            start = stop


def in_order(own: np.ndarray, size: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different sizes, one after the other in any order, in the order of their numbers."""
    order = np.argsort(own)
    begins = (np.cumsum(size) - size)[order]
    size = size[order]
    ends = np.cumsum(size)
    return flat[np.repeat(begins - (ends - size), size) + np.arange(len(flat))], size


def slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of slices of at most SLICE_ROWS texts of these sizes and, but for a single text, SLICE_CHARS characters."""
    start = size = 0
    for i, own in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or size + own > SLICE_CHARS):
            yield start, i
            start, size = i, 0
        size += own
    if sizes:
        yield start, len(sizes)


def sliced(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where each slice of a column of texts begins, and its texts, null as empty; only one slice is held as Python strings."""
    for a, b in slices(pc.fill_null(pc.utf8_length(column), 0).to_pylist()):
        yield a, [x or "" for x in column.slice(a, b - a).to_pylist()]


def list_array(lists: list) -> pa.ListArray:
    """Lists of int as one Arrow array, by way of one flat buffer."""
    flat = np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
    stops = np.append(0, np.cumsum([len(x) for x in lists], dtype=np.int64)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))
