"""Operator 8: byte-level BPE by corpus-level merge replay.

The distinct words of a large group of documents stand end to end in one
array of symbols. An inverted index from the rank of a token pair to the word
positions that hold it is replayed in rank order: each step merges every
position of the lowest rank at once, and only the touched neighbours enter
the index again. A text is then the concatenation of its words' ids.

Spark deals out the documents; every task replays the merges of its own
words, which needs no shuffle and keeps whole texts where they were read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from loadcast.llm.text import SPACE, ChunkTable, blank_separated, groups, ragged_take, sections
from loadcast.llm.workers import map_arrow

#: A run without white space, with a blank before it; or white space up to the next such run.
CHUNKS = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Texts in which white space is not just single characters between words.
UNEVEN = re.compile(rf"[{SPACE}][{SPACE}]|\A[{SPACE}]|[{SPACE}]\Z")

NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of byte strings, and the rank that each mergeable pair of tokens makes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]"))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.made = np.array(made, np.int32)[order]
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.token_lengths = np.array([len(b) for b in by_id], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.table = ChunkTable(self.encode_chunks, limit=700_000)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def replay(self, words: list[bytes]):
        """Ids of the words, flat, and the number of ids of each."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        word = np.repeat(np.arange(len(words)), sizes)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ends = (np.cumsum(sizes) - 1)[sizes > 0]
        after[ends] = n
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        rank = np.full(n + 1, NONE, np.int32)
        inner = np.flatnonzero(after < n)
        rank[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray):
            r = rank[positions]
            keep = r != NONE
            positions, r = positions[keep], r[keep]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            positions, r = positions[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            starts = [0, *cuts.tolist(), len(r)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                k = int(r[a])
                if k in index:
                    index[k].append(positions[a:b])
                else:
                    index[k] = [positions[a:b]]
                    heapq.heappush(heap, k)

        enter(inner)
        while heap:
            k = heapq.heappop(heap)
            found = index.pop(k)
            at = np.concatenate(found) if len(found) > 1 else found[0]
            at = at[rank[at] == k]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                # One merge a word, the leftmost; the others stay in the index.
                owner = word[at]
                first = np.empty(len(at), bool)
                first[0] = True
                np.not_equal(owner[1:], owner[:-1], out=first[1:])
                if not first.all():
                    index[k] = [at[~first]]
                    heapq.heappush(heap, k)
                    at = at[first]
            gone = after[at]
            symbols[at] = k
            alive[gone] = False
            rank[gone] = NONE
            nxt = after[gone]
            after[at] = nxt
            linked = nxt < n
            before[nxt[linked]] = at[linked]
            rank[at] = NONE
            here = at[linked]
            rank[here] = self.pair_ranks(symbols[here], symbols[nxt[linked]])
            left = before[at]
            has = left >= 0
            left = left[has]
            rank[left] = self.pair_ranks(symbols[left], symbols[at[has]])
            enter(np.concatenate([here, left]))
        return symbols[alive], np.bincount(word[alive], minlength=len(words))

    def encode_chunks(self, chunks: list[str]):
        """Ids of text chunks, flat, and their numbers: each match of the pattern is a word."""
        words: dict[str, int] = {}
        picks, counts = [], np.empty(len(chunks), np.int64)
        find = self.pattern.findall
        for i, chunk in enumerate(chunks):
            found = find(chunk)
            counts[i] = len(found)
            picks += [words.setdefault(w, len(words)) for w in found]
        flat, sizes = self.replay([w.encode("utf-8", "surrogatepass") for w in words])
        starts = np.cumsum(sizes) - sizes
        ids, lengths = ragged_take(flat, starts, sizes, np.array(picks, np.int64))
        upto = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[edges])

    def encode(self, texts: pa.Array):
        """Yield the ids of each text.

        Where white space is single characters, a blank belongs to the word
        after it and a line end stands alone: the parts between blanks are
        looked up with or without a blank. Other texts are cut by CHUNKS.
        """
        for group in groups(texts, 8 << 20):
            plain = group.to_pylist()
            uneven = {k: t for k, t in enumerate(plain) if UNEVEN.search(t)}
            parts, index, starts = blank_separated(pc.replace_substring(group, "\n", " \n "))
            ends_line = np.fromiter((p == "\n" for p in parts), bool, len(parts))[index]
            alone = ends_line.copy()
            alone[1:] |= ends_line[:-1]
            alone[starts[:-1]] = True
            used = np.unique(index[alone])
            chunks = [" " + p for p in parts] + [parts[k] for k in used]
            cut = {k: [c for piece in sections(t) for c in CHUNKS.findall(piece)] for k, t in uneven.items()}
            more = list(set().union(*cut.values()).difference(chunks)) if cut else []
            rows = self.table.rows(chunks + more)
            index[alone] = len(parts) + np.searchsorted(used, index[alone])
            ids, lengths = self.table.take(rows[index])
            ends = np.concatenate([[0], np.cumsum(lengths)])[starts]
            for k in range(len(plain)):
                if k in cut:
                    own = np.fromiter(map(self.table.__getitem__, cut[k]), np.int64, len(cut[k]))
                    yield self.table.take(own)[0]
                else:
                    yield ids[ends[k] : ends[k + 1]]

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged_take(self.token_bytes, self.token_starts, self.token_lengths, ids.astype(np.int64))[0].tobytes()


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str, pattern: str) -> Vocabulary:
    """One vocabulary a worker process."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Vocabulary(ranks, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns (id, ids array<int>, decoded binary); with ``digests`` instead
    (id, n_tokens, ids_sha256, decoded_sha256), made where the ids are.
    Null texts count as empty: no ids, empty bytes. Every row gives one row,
    repeated rows and null ids included; an empty table gives an empty one.
    ``ranks_path`` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"

    def rows(batches):
        vocab = vocabulary(ranks_path, pattern)
        try:
            yield from encoded(vocab, batches)
        finally:
            vocab.table.reset()  # the worker may serve other stages next

    def encoded(vocab, batches):
        for batch in batches:
            a, b, c, done = [], [], [], 0
            for ids in vocab.encode(batch.column(1)):
                ids = ids.astype("<u4")
                back = vocab.decode(ids)
                if digests:
                    a.append(len(ids))
                    b.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    c.append(hashlib.sha256(back).hexdigest())
                else:
                    a.append(ids.astype(np.int32))
                    b.append(back)
                if len(a) == 500:
                    yield record(batch.column(0).slice(done, 500), a, b, c)
                    done += 500
                    a, b, c = [], [], []
            if a:
                yield record(batch.column(0).slice(done, len(a)), a, b, c)

    def record(keys, a, b, c):
        if digests:
            cols = [pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())]
            return pa.RecordBatch.from_arrays([keys, *cols], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        cols = [pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.binary())]
        return pa.RecordBatch.from_arrays([keys, *cols], ["key", "ids", "decoded"])

    picked = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    return map_arrow(picked, rows, f"key {kind}, {out}").withColumnRenamed("key", id_col)
