"""A sparse document-term matrix in shards, with one dictionary for all of them.

Each task reads documents and encodes their words by a dictionary of its own
shard. Only the different words of each shard are shuffled: dealt out and
sorted by word, they are numbered as they stream by, which is the global
dictionary, and their numbers go back to their shard as one array. A shard is
then a matrix in compressed sparse rows whose columns are term ids. A word
that is in all documents costs one row per shard.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from loadcast.llm.components import written
from loadcast.llm.workers import map_arrow

#: Bytes of text in a shard; it ends with the batch that reaches them.
SHARD_BYTES = 16 << 20


def local_rows(texts: pa.Array):
    """(words, indptr, codes, counts) of texts: different words between ASCII white space, and their counts a text."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = parts.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    empty = pc.index(words, pa.scalar("", words.type)).as_py()  # where white space begins or ends a text
    if empty >= 0:
        owner, codes = owner[codes != empty], codes[codes != empty]
        codes -= codes > empty
        words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
    cells, counts = np.unique(owner * max(1, len(words)) + codes, return_counts=True)
    owner, codes = np.divmod(cells, max(1, len(words)))
    indptr = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(parts)), out=indptr[1:])
    return words, indptr, narrow(codes), narrow(counts)


def joined_rows(parts: list):
    """The rows of several ``local_rows`` by one dictionary."""
    coded = pa.concat_arrays([p[0].cast(pa.large_string()) for p in parts]).dictionary_encode()
    code_of, at, codes, bounds, n = coded.indices.to_numpy(), 0, [], [np.zeros(1, np.int64)], 0
    for words, indptr, own, _ in parts:
        codes.append(code_of[at : at + len(words)][own])
        bounds.append(indptr[1:] + n)
        at, n = at + len(words), n + int(indptr[-1])
    return coded.dictionary, np.concatenate(bounds), narrow(np.concatenate(codes)), narrow(np.concatenate([p[3] for p in parts]))


def narrow(numbers: np.ndarray) -> np.ndarray:
    """The numbers in the fewest bytes that hold all of them."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def widen(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // max(1, n) or 1}")


def local_shards(batches, size: int, measure):
    """Shards of rows (text, doc) by a dictionary of their own.

    Texts are encoded batch by batch, so that the lists of all their words are
    there for one batch at a time.
    """
    number = count(TaskContext.get().partitionId() << 32)

    def shard(held):
        docs = pa.concat_arrays([d for d, _ in held])
        words, indptr, codes, counts = joined_rows([rows for _, rows in held])
        columns = [pa.array([next(number)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                   pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                   *(pa.array([x.tobytes()], pa.binary()) for x in (indptr, codes, counts))]
        return pa.RecordBatch.from_arrays(columns, ["shard", "docs", "words", "indptr", "codes", "counts"])

    held, n = [], 0
    for batch in batches:
        texts, docs = batch.column(0).cast(pa.large_string()), batch.column(1)
        if measure:
            docs = pa.StructArray.from_arrays([docs, measure(texts)], ["row", "measured"])
        held.append((docs, local_rows(texts)))
        n += batch.column(0).nbytes
        if n >= size:
            yield shard(held)
            held, n = [], 0
    if held:
        yield shard(held)


def with_term_ids(indptr: bytes, codes: bytes, counts: bytes, terms):
    """(row bounds, term ids, counts) of a shard by the global dictionary, ids ascending within each document."""
    starts = np.frombuffer(indptr, np.int64)
    codes, numbers = widen(codes, starts[-1]), widen(counts, starts[-1]).astype(np.int32)
    ids = terms.values.to_numpy() if terms.is_valid else np.empty(0, np.int64)
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids)] = np.arange(len(ids))
    cells = rank[codes]
    cells += np.repeat(np.arange(len(starts) - 1) * max(1, len(ids)), np.diff(starts))
    order = np.argsort(cells)
    return starts, ids[codes[order]], numbers[order]


def whole_shards(batches):
    """The matrix itself: one row a shard."""
    for batch in batches:
        for k in range(batch.num_rows):
            shard, docs, *parts = (batch.column(c)[k] for c in range(6))
            starts, ids, numbers = with_term_ids(*(x.as_py() for x in parts[:3]), parts[3])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *(pa.array([x.tobytes()], pa.binary()) for x in (starts, ids, numbers))],
                ["shard", "docs", "indptr", "terms", "counts"])


def shard_sizes(batches):
    """Row sums and numbers of entries of the matrix: one row a document."""
    for batch in batches:
        for k in range(batch.num_rows):
            shard, docs, *parts = (batch.column(c)[k] for c in range(6))
            starts, ids, numbers = with_term_ids(*(x.as_py() for x in parts[:3]), parts[3])
            sums = np.concatenate([[0], np.cumsum(numbers, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([docs.values, pa.array(np.diff(sums[starts])), pa.array(np.diff(starts))],
                                             ["doc", "n_words", "n_terms"])


def numbered(batches):
    """Rows (word, shard, code), sorted by word, with the id of their word; one task holds all rows of a word."""
    at = (TaskContext.get().partitionId() << 32) - 1
    last = None
    for batch in batches:
        words = batch.column(0)
        new = np.ones(len(words), bool)
        new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
        if len(words):
            new[0] = words[0].as_py() != last
            last = words[-1].as_py()
        ids = at + np.cumsum(new)
        at = int(ids[-1]) if len(ids) else at
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], [*batch.schema.names, "term_id"])


def encoded_shards(docs: DataFrame, text_col: str, size: int, measure, measured: str):
    """(shards by their own codes, (word, shard, code, term_id) of all shards, type of a document)."""
    others = [c for c in docs.columns if c != text_col]
    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("doc"))
    kind = own.schema["doc"].dataType  # names may hold dots, so it is kept as a type
    if measure:
        kind = StructType().add("row", kind).add("measured", StructType.fromDDL(measured))
    schema = StructType().add("shard", "long").add("docs", ArrayType(kind)).add("words", ArrayType(StringType()))
    for part in ("indptr", "codes", "counts"):
        schema = schema.add(part, "binary")
    shards = written(map_arrow(own, lambda b: local_shards(b, size, measure), schema), "shards", compression="zstd")
    words = shards.select("shard", F.posexplode("words").alias("code", "word")).select("word", "shard", "code")
    places = map_arrow(words.repartition("word").sortWithinPartitions("word"), numbered, "word string, shard long, code int, term_id long")
    return shards.drop("words"), places, kind


def with_ids(shards: DataFrame, places: DataFrame) -> DataFrame:
    """The shards with the term ids of their codes, in the order of the codes."""
    terms = (places.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("code", "term_id"))).alias("at"))
             .select("shard", F.col("at.term_id").alias("ids")))
    return shards.join(terms, "shard", "left")


def document_terms(docs: DataFrame, text_col: str = "text", size: int = SHARD_BYTES):
    """(matrix, dictionary) of the texts' words, which are runs of characters other than ``\\x20\\x09-\\x0D``.

    matrix: (shard, docs, indptr, terms, counts), the other columns of the
    documents as an array of structs and a matrix in compressed sparse rows:
    64-bit row bounds, 64-bit term ids, 32-bit counts. dictionary: (word,
    term_id).

    Null and empty texts are rows without entries. Words are case sensitive.
    Every row of ``docs`` is a row of the matrix, repeated ones too; an empty
    table has no shards. Column names may be any.
    """
    shards, places, kind = encoded_shards(docs, text_col, size, None, "")
    places = written(places, "places")  # the matrix and the dictionary go by the same numbers
    schema = StructType().add("shard", "long").add("docs", ArrayType(kind))
    for part in ("indptr", "terms", "counts"):
        schema = schema.add(part, "binary")
    matrix = map_arrow(with_ids(shards, places), whole_shards, schema)
    return matrix, places.select("word", "term_id").distinct()


def row_sizes(docs: DataFrame, text_col: str = "text", size: int = SHARD_BYTES, measure=None, measured: str = "") -> DataFrame:
    """(doc, n_words, n_terms): row sums and numbers of entries of the matrix of ``document_terms``, one row a document.

    ``doc`` is a struct of the other columns. With ``measure``, a function
    from an array of texts to a struct array of the fields ``measured``, it is
    a struct (row, measured).
    """
    shards, places, kind = encoded_shards(docs, text_col, size, measure, measured)
    return map_arrow(with_ids(shards, places), shard_sizes, StructType().add("doc", kind).add("n_words", "long").add("n_terms", "long"))
