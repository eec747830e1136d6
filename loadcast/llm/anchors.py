"""Content-defined anchors: positions that equal byte strings choose alike."""

from __future__ import annotations

import numpy as np

from loadcast.llm.text import mix

#: Bytes of a gram; a match of ``length`` bytes shares at least one anchored gram.
GRAM = 20


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hashes of all grams of ``size`` bytes, by doubling."""
    out = raw.astype(np.uint64) + np.uint64(1)
    power, width, done, done_width = np.uint64(0x9E3779B97F4A7C15), 1, None, 0
    with np.errstate(over="ignore"):
        rest = size
        while rest:
            if rest & 1:
                if done is None:
                    done, done_width = out, width
                else:
                    n = len(raw) - done_width - width + 1
                    done = done[:n] * power + out[done_width : done_width + n]
                    done_width += width
            rest >>= 1
            if rest:
                n = len(raw) - 2 * width + 1
                out = out[:n] * power + out[width : width + n]
                power, width = power * power, 2 * width
    return mix(done)


#: Positions of a gram fit the lower bits of a sort key, its hash the upper ones.
POSITION_BITS = 24
SECTION = (1 << POSITION_BITS) - 64

#: Anchors are known by the upper 48 bits of their hashes, which take less room in a shuffle; two
#: grams with the same ones are merely compared in vain.
SPARE = np.uint64(16)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every window of ``width`` values, by doubling."""
    step, out = 1, x
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    if step < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - step :])
    return out


def anchors(raw: np.ndarray, length: int, size: int = GRAM):
    """(hashes of 48 bits, first, end) of the anchors and of the bytes that they stand for.

    The anchor of a run of ``length`` bytes is its gram of least hash, the
    leftmost of equal ones, so equal runs have equal anchors at the same place
    within them. ``raw[first:end]`` is the union of the runs that have an
    occurrence as their anchor. Fewer bytes than ``length`` have none.
    """
    out = []
    for at in range(0, max(len(raw) - length + 1, 0), SECTION):
        part = raw[at : at + SECTION + length - 1]
        hashes = gram_hashes(part, size)
        places = np.arange(len(hashes), dtype=np.uint64)
        low = np.uint64((1 << POSITION_BITS) - 1)
        least = sliding_minimum((hashes & ~low) | places, length - size + 1)
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        out.append(((hashes[place[first]] >> SPARE).astype(np.int64), first + at, last + length + at))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
