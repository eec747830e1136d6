"""Small per-row helpers that the text operators share inside their tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Code points that count as white space for the vocabulary patterns (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"

SECTION_CHARS = 1 << 20


def sections(text: str, size: int = SECTION_CHARS):
    """Cut a long text in front of single blanks between words, in pieces of about ``size``.

    Splitting the pieces at blanks gives the words of the whole text, so that a
    document of any length is processed in bounded memory.
    """
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= n:
                cut = n
                break
            if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                break
            cut += 1
        yield text[at:cut]
        at = cut
    if at < n:
        yield text[at:]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """The upper 53 bits as doubles in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class WordHashes(dict):
    """64-bit hashes by word, remembered up to a fixed number of words."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h
        return h

    def of(self, text: str) -> np.ndarray:
        """The hashes of a text's white-space separated words, in order."""
        parts = []
        for piece in sections(text):
            words = piece.split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` words; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k]
    return mix(out)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray):
    """Concatenate ``flat[starts[p] : starts[p] + lengths[p]]`` over the picks; also their lengths."""
    n = lengths[picks]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total, dtype=np.int64) + np.repeat(starts[picks] - (ends - n), n)
    return flat[where], n


class ChunkTable(dict):
    """Token ids of text chunks: a dictionary into one ragged array of bounded size.

    ``encode`` maps a list of new chunks to (flat ids, lengths). Once the table
    holds ``limit`` chunks, the older half of them goes.
    """

    def __init__(self, encode, limit: int = 500_000):
        super().__init__()
        self.encode, self.limit, self.stage = encode, limit, None
        self.reset()

    def reset(self):
        self.clear()
        self.flat = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def serve(self, stage):
        """Start anew for another stage: what the last one looked up is not kept beside it."""
        if stage != self.stage:
            self.reset()
            self.stage = stage

    def halve(self):
        gone = len(self.starts) // 2
        at = int(self.starts[gone]) if gone < len(self.starts) else len(self.flat)
        left = {c: row - gone for c, row in self.items() if row >= gone}
        self.clear()
        self.update(left)
        self.flat, self.starts, self.lengths = self.flat[at:].copy(), self.starts[gone:] - at, self.lengths[gone:].copy()

    def rows(self, chunks: list[str]) -> np.ndarray:
        """The rows of different chunks; new ones are encoded."""
        if len(self) > self.limit:
            self.halve()
        found = list(map(self.get, chunks))
        new = [c for c, row in zip(chunks, found, strict=True) if row is None]
        if new:
            flat, lengths = self.encode(new)
            base = len(self.starts)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
            self.update(zip(new, range(base, base + len(new)), strict=True))
            found = list(map(self.__getitem__, chunks))
        return np.array(found, np.int64)

    def take(self, rows: np.ndarray):
        """The ids of the rows, flat, and their numbers."""
        return ragged_take(self.flat, self.starts, self.lengths, rows)


#: Bytes of text whose chunks are looked up together.
GROUP_BYTES = 4 << 20


def groups(texts: pa.Array, size: int = GROUP_BYTES):
    """Slices of a text column of about ``size`` bytes, null texts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy()
    at, held = 0, 0
    for k, own in enumerate(sizes):
        held += int(own)
        if held >= size:
            yield texts[at : k + 1]
            at, held = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def blank_separated(texts: pa.Array):
    """The texts' parts between blanks: (different parts, index of each part, first part of each text and the end)."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    starts = parts.offsets.to_numpy().astype(np.int64)
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist
    return words, coded.indices.to_numpy().astype(np.int64), starts - starts[0]
