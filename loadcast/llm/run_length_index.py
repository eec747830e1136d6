"""A run-length compressed Burrows-Wheeler index, and matching statistics from its run ends.

The order of a text's suffixes gives its Burrows-Wheeler transform, the
symbol in front of each suffix. Within a run of equal symbols, a suffix and
the one before it in the order agree for one symbol less than the two
suffixes that begin with the run's symbol, so the length of that agreement
needs to be known at the run ends alone. There it is sampled by comparing the text; all
other values follow by streaming through the text in its own order. In
repetitive text the runs, and hence the samples, are few.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Symbols that the first sort compares: 9 bits each in 63.
FIRST = 7


def packed(symbols: np.ndarray) -> np.ndarray:
    """The next FIRST symbols of each position as one number; past the end is less than any symbol."""
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(FIRST, np.int64)])
    out = np.zeros(n, np.int64)
    for k in range(FIRST):
        out = (out << 9) | wide[k : n + k]
    return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling.

    Each round sorts only the positions whose rank others share.
    """
    n = len(symbols)
    keys = packed(symbols)
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)  # the row at which a group of equal prefixes begins
    rank[order], rank[n] = first, -1
    width = FIRST
    # Rows of groups with more than one position.
    rows = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(rows):
        at = order[rows]
        after = rank[np.minimum(at + width, n)]
        group = rank[at]
        inner = np.argsort(group * (n + 1) + after)
        at, after, group = at[inner], after[inner], group[inner]
        order[rows] = at
        fresh = np.concatenate([[True], (after[1:] != after[:-1]) | (group[1:] != group[:-1])])
        first = np.maximum.accumulate(np.where(fresh, rows, 0))
        rank[at] = first
        rows = rows[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    return order


@dataclass
class RunLengthIndex:
    """``heads`` are the rows at which a run begins; its symbol and the sampled suffix stand beside."""

    n: int
    heads: np.ndarray
    letters: np.ndarray
    samples: np.ndarray      # the suffix at the head
    before: np.ndarray       # the suffix one row above it, the end of the run before

    @classmethod
    def build(cls, symbols: np.ndarray, order: np.ndarray) -> RunLengthIndex:
        transform = symbols[order - 1]  # cyclic: the last symbol stands in front of the first
        head = np.concatenate([[True], transform[1:] != transform[:-1]])
        # The suffix at the text's start has no symbol before it, so it and the row below are samples too.
        start = int(np.flatnonzero(order == 0)[0])
        head[start : start + 2] = True
        heads = np.flatnonzero(head)
        return cls(len(order), heads, transform[heads], order[heads], order[heads - 1])

    def statistics(self, symbols: np.ndarray) -> np.ndarray:
        """For each text position: how far its suffix agrees with the one above it in the order."""
        agree = agreement(symbols, self.samples[1:], self.before[1:])
        reach = np.zeros(self.n, np.int64)
        reach[self.samples[1:]] = agree + self.samples[1:]
        reach[self.samples[0]] = self.samples[0]
        return np.maximum.accumulate(reach) - np.arange(self.n)


def agreement(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at ``a`` and ``b``."""
    n = len(symbols)
    keys = np.append(packed(symbols), -1)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        same = keys[np.minimum(a[live] + out[live], n)] == keys[np.minimum(b[live] + out[live], n)]
        live = live[same]
        out[live] += FIRST
    letters = np.append(symbols.astype(np.int64), -1)
    live = np.arange(len(a))
    for _ in range(FIRST):
        x, y = np.minimum(a[live] + out[live], n), np.minimum(b[live] + out[live], n)
        live = live[letters[x] == letters[y]]
        out[live] += 1
    return out


def joined(pieces: pa.Array):
    """The pieces as one text of symbols (byte + 1), each closed by 0; also starts and sizes."""
    sizes = pc.binary_length(pieces).to_numpy().astype(np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.zeros(int(sizes.sum()) + len(pieces), np.uint16)
    body = np.ones(len(symbols), bool)
    body[starts + sizes] = False
    flat = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)
    symbols[body] = flat.astype(np.uint16) + np.uint16(1)
    return symbols, starts, sizes


def matched_spans(pieces: pa.Array, owners: np.ndarray, length: int):
    """(piece, first, end) of the maximal runs of starts at which ``length`` bytes begin that a
    piece of a smaller owner holds too; ``end`` is where the last of them ends."""
    symbols, starts, sizes = joined(pieces)
    order = suffix_order(symbols)
    agree = RunLengthIndex.build(symbols, order).statistics(symbols)[order]
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    fresh = agree < length
    fresh[0] = True
    owner = owners[piece]
    owner_rows = owner[order]
    least = np.minimum.reduceat(owner_rows, np.flatnonzero(fresh))
    flags = np.zeros(len(symbols) + 2, np.int8)
    flags[order + 1] = least[np.cumsum(fresh) - 1] < owner_rows
    inside = np.arange(len(symbols)) - starts[piece] + length <= sizes[piece]
    flags[1:-1] &= inside
    edges = np.diff(flags)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    return piece[first], first - starts[piece[first]], last - starts[piece[last]] + length
