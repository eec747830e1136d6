"""Operator 5: cost-balanced packing of tokenised documents into sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, the work of the
linear layers and of attention within the piece. Documents are taken in
descending cost, each going to the sequence of lowest cost that has room for
it; a document that fits nowhere is cut, and the cheapest sequence takes what
it has room for.

Spark deals out the documents. A task tokenises its own rows and packs them
in groups of ``group_tokens``, each in its own descending order, so ids never cross the network, memory is
bounded by a group, and nothing depends on other tasks. The group's tokens
decide its sequences: as many of full length as they fill, and the remainder
in sequences of falling powers of two, which need no padding either.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from loadcast.llm.text import ChunkTable, blank_separated, groups, ragged_take
from loadcast.llm.workers import map_arrow

#: A control character that no chunk holds parts the chunks of one call.
PART = "\x02"

GROUP_TOKENS = 2 << 20

#: Chunks whose ids a worker keeps while it serves one stage.
KEPT_CHUNKS = 600_000


@lru_cache(maxsize=2)
def word_table(path: str) -> ChunkTable:
    """The chunk table of a tokenizer file, one a worker process."""
    tokenizer = Tokenizer.from_file(path)
    part_id = np.uint32(tokenizer.encode(PART, add_special_tokens=False).ids[0])
    vocabulary = tokenizer.get_vocab()
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_word[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def ids_of(texts: list[str]) -> np.ndarray:
        # The batch call of one text is the one that spares the places of the tokens in it.
        return np.array(tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)

    def encode_words(words: list[str]):
        """Words of letters are one unit each, which its last token ends."""
        flat, lengths = [], []
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = ids_of(part)
            ends = np.flatnonzero(ends_word[ids])
            if len(ends) != len(part):  # folding case has made marks of some letters
                found = [ids_of([word]) for word in part]
                ids, ends = np.concatenate(found), np.cumsum([len(x) for x in found]) - 1
            flat.append(ids)
            lengths.append(np.diff(ends, prepend=-1))
        return flat, lengths

    def encode_others(chunks: list[str]):
        flat, lengths = [], []
        for at in range(0, len(chunks), 1000):
            part = chunks[at : at + 1000]
            if any(PART in chunk for chunk in part):
                found = [ids_of([chunk]) for chunk in part]
                lengths.append(np.array([len(x) for x in found], np.int64))
                flat += found
                continue
            ids = ids_of([f"{chunk} {PART}" for chunk in part])
            ends = np.flatnonzero(ids == part_id)
            lengths.append(np.diff(ends, prepend=-1) - 1)
            flat.append(ids[ids != part_id])
        return flat, lengths

    def encode(new: list[str]):
        words: dict[str, int] = {}
        marks = [".", ","]
        others, shape = [], []  # a chunk is a word, a word and a mark, or something else
        for chunk in new:
            folded = chunk if chunk.isascii() else chunk.lower()  # which may part a letter into one and a mark
            if folded.isalpha():
                shape.append((words.setdefault(chunk, len(words)), -1))
            elif folded[-1:] in (".", ",") and folded[:-1].isalpha():
                shape.append((words.setdefault(chunk[:-1], len(words)), marks.index(chunk[-1])))
            else:
                shape.append((-1, len(others)))
                others.append(chunk)
        parts = [encode_words(list(words)), encode_others(marks + others)]
        flat = np.concatenate([np.empty(0, np.uint32), *(x for p in parts for x in p[0])])
        lengths = np.concatenate([np.empty(0, np.int64), *(x for p in parts for x in p[1])])
        starts = np.cumsum(lengths) - lengths
        word, rest = np.array(shape, np.int64).reshape(-1, 2).T
        rest = np.where(word < 0, rest + len(marks), rest)
        # The two halves of each chunk one after the other; an absent half is left out.
        picks = np.stack([word, np.where(rest < 0, -1, rest + len(words))], axis=1)
        there = picks >= 0
        ids, n = ragged_take(flat, starts, lengths, picks[there])
        sizes = np.zeros(picks.shape, np.int64)
        sizes[there] = n
        return ids, sizes.sum(axis=1)

    table = ChunkTable(encode, KEPT_CHUNKS)
    table.whole = ids_of
    table.special = [t.content.lower() for t in tokenizer.get_added_tokens_decoder().values()]
    return table


def tokenise(texts: pa.Array, table: ChunkTable):
    """Yield the ids of each text.

    Blanks and line ends are white space to the tokenizer, which encodes what
    lies between apart and folds case itself, so parts are looked up with
    ASCII letters in lower case. A text that spells out a special token of the
    tokenizer is encoded whole, as the tokenizer finds those before all else.
    """
    for group in groups(texts):
        lower = pc.ascii_lower(pc.replace_substring(group, "\n", " "))
        spelt = np.zeros(len(group), bool)
        for token in table.special:
            spelt |= pc.match_substring(lower, token).to_numpy(zero_copy_only=False)
        parts, index, starts = blank_separated(lower)
        ids, lengths = table.take(table.rows(parts)[index])
        ends = np.concatenate([[0], np.cumsum(lengths)])[starts]
        for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            yield table.whole([group[k].as_py()]) if spelt[k] else ids[a:b]


def sequence_sizes(total: int, longest: int) -> list[int]:
    """Sequences that hold ``total`` tokens without padding."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Room:
    """Sequences by the room they have left, the cheapest first: a tree of minima over the amounts of room."""

    def __init__(self, longest: int):
        self.size = 1 << longest.bit_length()
        self.best = [None] * (2 * self.size)  # (cost, sequence) that is cheapest among a node's amounts
        self.held = [[] for _ in range(longest + 1)]

    def put(self, room: int, entry):
        heapq.heappush(self.held[room], entry)
        self.settle(room)

    def take(self, room: int):
        """Remove the cheapest sequence of exactly this room."""
        entry = heapq.heappop(self.held[room])
        self.settle(room)
        return entry

    def settle(self, room: int):
        at = self.size + room
        self.best[at] = (*self.held[room][0], room) if self.held[room] else None
        while at > 1:
            at //= 2
            a, b = self.best[2 * at], self.best[2 * at + 1]
            self.best[at] = a if b is None or (a is not None and a < b) else b

    def cheapest(self, least: int):
        """(cost, sequence, room) of the cheapest with at least this room, or None."""
        found, low, high = None, self.size + least, 2 * self.size
        while low < high:
            if low & 1:
                if self.best[low] is not None and (found is None or self.best[low] < found):
                    found = self.best[low]
                low += 1
            if high & 1:
                high -= 1
                if self.best[high] is not None and (found is None or self.best[high] < found):
                    found = self.best[high]
            low, high = low // 2, high // 2
        return found


def assign(lengths, longest: int, linear: float = 1.0, quadratic: float = 1.0 / 4096):
    """Pack documents of the given lengths; yields (document, start, length, sequence, offset).

    Pieces of one document come in the order of their starts. Every token of
    every document lies in exactly one piece and every sequence is full.
    """
    sizes = sequence_sizes(int(sum(lengths)), longest)
    room = Room(longest)
    for sequence, size in enumerate(sizes):
        heapq.heappush(room.held[size], (0.0, sequence))
    for size in set(sizes):
        room.settle(size)

    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, lengths[doc]
        while left:
            cost, sequence, free = room.cheapest(min(left, longest)) or room.cheapest(1)
            room.take(free)
            n = min(left, free)
            yield doc, start, n, sequence, sizes[sequence] - free
            if free > n:
                room.put(free - n, (cost + linear * n + quadratic * n * n, sequence))
            start += n
            left -= n


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 4096, end_id: int = 2, id_col: str = "doc_id",
         text_col: str = "text", group_tokens: int = GROUP_TOKENS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length.

    A document is its tokens and ``end_id``; a null or empty text is that id
    alone. Repeated rows and null ids are documents of their own. A sequence
    id is the task's partition and a running number in it: unique, and the
    same when a lost task runs again. With ``keep_ids`` the ids come along.
    An empty table gives no rows. ``tokenizer_path`` must be readable on
    every executor.
    """
    kind = docs.schema[id_col].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]

    def rows(batches):
        table, context = word_table(tokenizer_path), TaskContext.get()
        table.serve(context.stageId() if context else None)
        sequence = (context.partitionId() if context else 0) << 40
        keys, ids, held = [], [], 0
        for batch in batches:
            own = batch.column(0).to_pylist()
            for key, found in zip(own, tokenise(batch.column(1), table), strict=True):
                keys.append(key)
                ids.append(np.append(found, np.uint32(end_id)).astype("<u4"))
                held += len(ids[-1])
                if held >= group_tokens:
                    done = yield from flush(batch.column(0).type, keys, ids, sequence)
                    sequence, keys, ids, held = done, [], [], 0
            key_type = batch.column(0).type
        if keys:
            yield from flush(key_type, keys, ids, sequence)

    def flush(key_type, keys, ids, sequence):
        lengths = [len(x) for x in ids]
        sizes = sequence_sizes(sum(lengths), longest)
        out = [[] for _ in range(8)]
        kept = []
        for doc, start, n, seq, offset in assign(lengths, longest):
            piece = ids[doc][start : start + n]
            for column, value in zip(out, (keys[doc], start, n, zlib.crc32(piece.tobytes()), lengths[doc], sequence + seq, offset, sizes[seq]), strict=True):
                column.append(value)
            if keep_ids:
                kept.append(piece.astype(np.int32))
        columns = [pa.array(out[0], key_type), *(pa.array(c, pa.int64()) for c in out[1:])]
        if keep_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, ["key", *names, *["ids"] * keep_ids])
        return sequence + len(sizes)

    picked = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = f"key {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", ids array<int>" * keep_ids
    return map_arrow(picked, rows, schema).withColumnRenamed("key", id_col)
