"""Operator 3: removal of byte strings that an earlier document holds, by run-length indexes.

Every byte covered by a ``length``-byte string that also starts in a document
with a smaller id is removed. Equal strings share a content-defined anchor,
so only anchors that two documents hold can lie in a match:

1. Texts equal to one with a smaller id are copies and removed as a whole.
2. The other texts' anchors are shuffled as (hash, id) and those of one
   document alone are dropped. Anchors that a task sees in two documents are known
   to be shared there, so a hot one meets the others as one row a task.
3. Around each remaining anchor, the bytes that a match through it can reach are
   dealt out by the anchor. Equal surroundings are one piece, owned by the smallest
   id; every other holder of the piece loses it. That is settled within each task
   first, so a passage of very many documents is dealt out once a task. The different pieces of
   neighbouring anchors form a block of bounded size, whose run-length index
   gives the matching statistics and the long matches.
4. The matched spans return to their documents.

Hot strings: equal surroundings are told apart while a sorted partition streams
by, so a passage of very many documents is held in memory once. The table of
texts is shuffled once, by id, and that exchange serves all steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from loadcast.llm.anchors import SPARE, anchors
from loadcast.llm.run_length_index import matched_spans
from loadcast.llm.text import mix, ragged_take
from loadcast.llm.workers import map_arrow

LENGTH = 50

#: Anchors have 48 bits; the salts of rows known to be shared lie above them.
ANCHOR_BITS = 64 - int(SPARE)
ANCHOR = (1 << ANCHOR_BITS) - 1
SALTS = 30_000

#: Bytes of pieces that are indexed together.
BLOCK = 1 << 20


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, ascending."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def anchor_rows(batches, length: int = LENGTH, part: int = 2000, most: int = 1 << 20):
    """(anchor, id) rows that tell which anchors several ids hold, few of them for a hot anchor.

    An anchor that two ids of a part of ``part`` documents hold is known to be
    shared. Its rows carry a salt by id in the bits above the anchor, so
    they are spread over the tasks that come next and wait for no other row;
    one more row, of the least id and without salt, stands for all of them
    where the anchor's other documents meet. A task sends it once for as
    long as it remembers the anchor (the last ``most`` shared ones).
    """
    told, fresh = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, part):
            ids, found = [], []
            for key, raw in zip(batch.column(0)[at : at + part].to_pylist(), batch.column(1)[at : at + part], strict=True):
                own = np.unique(anchors(np.frombuffer(raw.as_buffer(), np.uint8), length)[0])
                ids.append(np.full(len(own), key, np.int64))
                found.append(own)
            ids, found = np.concatenate(ids), np.concatenate(found)
            order = np.lexsort((ids, found))
            ids, found = ids[order], found[order]
            # Rows of one id and anchor are one; a group of them with different ids is shared.
            new = np.concatenate([[True], (found[1:] != found[:-1]) | (ids[1:] != ids[:-1])])[: len(ids)]
            ids, found = ids[new], found[new]
            heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(ids)])
            sizes = np.diff(np.append(heads, len(ids)))
            before = within(found[heads], told) | within(found[heads], fresh)
            known = np.repeat((sizes > 1) | before, sizes)
            first = heads[(sizes > 1) & ~before]
            fresh = np.union1d(fresh, found[first])
            if len(fresh) > most // 2:
                told, fresh = fresh, told[:0]
            salt = (mix(ids[known].view(np.uint64)) % np.uint64(SALTS)).astype(np.int64) + 1
            anchor = np.concatenate([found[~known], found[first], found[known] | salt << ANCHOR_BITS])
            ids = np.concatenate([ids[~known], ids[first], ids[known]])
            # Rows of a document side by side take less room in the shuffle than rows by anchor.
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(anchor[order]), pa.array(ids[order])], ["anchor", "id"])


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values an ascending array holds."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def match_pieces(batches, length: int = LENGTH, block: int = BLOCK):
    """Spans (id, th, first, end) from rows (anchor, piece, id, th, at, size) sorted by all of them.

    A row without a piece is a span that a smaller id is known to hold.

    A piece's owner is its first, smallest id. Later ids lose the whole piece
    at once and are forgotten; what is kept of an anchor are its different
    pieces. Anchors whose pieces have several owners are indexed in blocks.
    """
    left = None  # the owners' rows of the last anchor, which may go on
    done, held = [], 0

    def index(tables):
        table = pa.concat_tables(tables).combine_chunks()
        pieces = table.column("piece").combine_chunks()
        anchor, ids = table.column("anchor").to_numpy(), table.column("id").to_numpy()
        code = pieces.dictionary_encode().indices.to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (anchor[1:] != anchor[:-1])]))
        counts = np.diff(np.append(heads, len(code)))
        piece, first, end = matched_spans(pieces.take(pa.array(heads)), ids[heads], length)
        # An owner that holds its piece at several places loses the spans at each.
        rows, n = ragged_take(np.arange(len(code)), heads, counts, piece)
        at = table.column("at").to_numpy()[rows]
        return spans(ids[rows], table.column("th").to_numpy()[rows], at + np.repeat(first, n), at + np.repeat(end, n))

    for batch in batches:
        known = batch.filter(pc.is_null(batch.column(1)))
        if known.num_rows:
            ids, th, at, size = (known.column(k).to_numpy() for k in (2, 3, 4, 5))
            yield spans(ids, th, at, at + size)
        table = pa.Table.from_batches([batch.filter(pc.is_valid(batch.column(1)))])
        if not table.num_rows:
            continue
        if left is not None:
            table = pa.concat_tables([left, table])
        pieces = table.column("piece").combine_chunks()
        anchor, ids = table.column("anchor").to_numpy(), table.column("id").to_numpy()
        code = pieces.dictionary_encode().indices.to_numpy()
        sizes = pc.binary_length(pieces).to_numpy()
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (anchor[1:] != anchor[:-1])])
        heads = np.flatnonzero(new)
        owner = np.repeat(ids[heads], np.diff(np.append(heads, len(ids))))
        lost = np.flatnonzero(ids > owner)
        if len(lost):
            at = table.column("at").to_numpy()[lost]
            yield spans(ids[lost], table.column("th").to_numpy()[lost], at, at + sizes[lost])
        mine = ids == owner
        # Anchors with more than one owner, told from the first and last rows of each.
        groups = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        several = np.minimum.reduceat(owner, groups) < np.maximum.reduceat(owner, groups)
        several = np.repeat(several, np.diff(np.append(groups, len(ids))))
        open_end = anchor == anchor[-1]
        left = table.take(pa.array(np.flatnonzero(mine & open_end)))
        keep = np.flatnonzero(mine & several & ~open_end)
        if len(keep):
            done.append(table.take(pa.array(keep)))
            held += int(sizes[keep].sum())
        if held >= block:
            yield index(done)
            done, held = [], 0
    if left is not None:
        last = left.column("id").to_numpy()
        if last.min() < last.max():
            done.append(left)
    if done:
        yield index(done)


def spans(ids, th, first, end) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), *(pa.array(c.astype(np.int32), pa.int32()) for c in (th, first, end))]
    return pa.RecordBatch.from_arrays(columns, ["id", "th", "first", "end"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept binary, kept_text, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    ``kept_text`` are the kept bytes without characters of which a part was removed.
    The columns named by ``carry`` come along; of rows with the same id and text the
    smallest one's. They meet the texts where these are already dealt out by id.

    A null text counts as empty; texts shorter than ``length`` bytes keep all.
    Strings are judged on the input. Rows with the same id do not remove from
    each other; null ids neither lose nor remove anything. Ids are integers.
    An empty table gives an empty one. Texts of any length are read whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    # The same filter in front of the shuffle by id everywhere, so that all steps share that exchange.
    fit = F.col("id").isNotNull() & (F.length("raw") >= length)
    able = rows.where(fit)
    known = able.select("id", F.hash("raw").alias("th"), F.md5("raw").alias("same"))
    firsts = known.groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # What is known of an id beforehand: which of its texts are copies, and whether it has several.
    copy = F.when(F.col("id") > F.col("first"), F.col("th"))
    told = (known.join(firsts, "same", "left").groupBy("id")
            .agg(F.collect_set(copy).alias("copies"), (F.min("th") < F.max("th")).alias("several"))
            .where((F.size("copies") > 0) | F.col("several")))
    th = F.hash("raw")
    base = (able.join(told, "id", "left")
            .select("id", "raw", F.when(F.col("several"), th).otherwise(F.lit(0)).alias("th"),
                    F.coalesce(F.array_contains("copies", th), F.lit(False)).alias("copy")))
    single = base.where(~F.col("copy"))

    held = map_arrow(single.select("id", "raw"), lambda batches: anchor_rows(batches, length), "anchor long, id long")
    over = Window.partitionBy("anchor")
    shared = (held.select("anchor", "id", F.min("id").over(over).alias("low"), F.max("id").over(over).alias("high"))
              .where((F.col("low") < F.col("high")) | (F.col("anchor") > ANCHOR))
              .groupBy("id").agg(F.collect_set(F.col("anchor").bitwiseAND(ANCHOR)).alias("shared")))

    def piece_rows(batches):
        for batch in batches:
            anchor, first, end, ids, th, pieces = [], [], [], [], [], []
            for key, raw, text_hash, mine in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), batch.column(3), strict=True):
                hashes, a, b = anchors(np.frombuffer(raw, np.uint8), length)
                keep = np.flatnonzero(np.isin(hashes, mine.values.to_numpy()))
                anchor.append(hashes[keep])
                first.append(a[keep])
                end.append(b[keep])
                ids.append(np.full(len(keep), key, np.int64))
                th.append(np.full(len(keep), text_hash, np.int32))
                pieces += [raw[i:j] for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]
            anchor, first, end, ids, th = (np.concatenate(c) for c in (anchor, first, end, ids, th))
            # Of a piece that several of these documents hold, the smallest id's alone is dealt out.
            code = pa.array(pieces, pa.binary()).dictionary_encode().indices.to_numpy()
            order = np.lexsort((ids, code))
            heads = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]])) if len(order) else order
            owner = np.empty(len(code), np.int64)
            owner[order] = np.repeat(ids[order][heads], np.diff(np.append(heads, len(order))))
            lost = ids > owner
            anchor = np.where(lost, (mix((ids * 4099 + first).view(np.uint64)) >> SPARE).astype(np.int64), anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(pieces, pa.binary(), mask=lost), pa.array(ids), pa.array(th),
                 pa.array(first.astype(np.int32)), pa.array((end - first).astype(np.int32))],
                ["anchor", "piece", "id", "th", "at", "size"])

    pieces = map_arrow(single.join(shared, "id").select("id", "raw", "th", "shared"), piece_rows,
                       "anchor long, piece binary, id long, th int, at int, size int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor", "piece", "id", "th", "at")
    spans = map_arrow(dealt, lambda batches: match_pieces(batches, length), "id long, th int, first int, end int")
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("th", "first", "end")).alias("spans"))

    def cut(raw: bytes, copy: bool, spans):
        gone = [(0, len(raw))] if copy else merged(spans)
        upto, kept = 0, []
        for a, b in gone:
            kept.append(raw[upto:a])
            upto = b
        kept.append(raw[upto:])
        return b"".join(kept), len(gone)

    def final_rows(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = [[], [], [], [], [], []]
                for raw, th, copy, spans in zip(*(part.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                    kept, n = cut(raw, copy, [(s["first"], s["end"]) for s in spans or () if s["th"] == th])
                    for column, value in zip(out, (kept, kept.decode("utf-8", "ignore"), len(raw), len(raw) - len(kept), n,
                                                        hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(value)
                kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True)), *part.columns[5:]],
                    ["id", "kept", "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256", *part.schema.names[5:]])

    whole = base.join(spans, "id", "left").select("id", "raw", "th", "copy", "spans")
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.col(id_col).cast("long")
    there = [F.col(f"c{k}") for k in range(len(carry))]
    if carry:
        one = (docs.where(key.isNotNull() & (F.length(body) >= length)).groupBy(key.alias("id"), F.hash(body).alias("h"))
               .agg(F.min(F.struct(*own)).alias("row")))
        by_id = one.groupBy("id").agg(F.collect_list(F.struct("h", "row")).alias("rows"))
        mine = F.filter("rows", lambda x: x["h"] == F.hash("raw"))[0]["row"]
        whole = whole.join(by_id, "id").select("id", "raw", "th", "copy", "spans", mine.alias("row")).select(
            "id", "raw", "th", "copy", "spans", "row.*")
    untouched = docs.select(key.alias("id"), body.alias("raw"), *own).where(~fit).select(
        "id", "raw", F.lit(0).alias("th"), F.lit(False).alias("copy"),
        F.lit(None).cast("array<struct<th:int,first:int,end:int>>").alias("spans"), *there)
    whole = whole.unionByName(untouched)

    schema = "id long, kept binary, kept_text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kinds = "".join(f", c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    out = map_arrow(whole, final_rows, schema + kinds).withColumnRenamed("id", id_col)
    return out.withColumnsRenamed({f"c{k}": c for k, c in enumerate(carry)})
