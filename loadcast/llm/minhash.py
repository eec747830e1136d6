"""Operator 1: near-duplicate detection by DartMinHash signatures and banded joining.

A document is a weighted set of five-word shingles. Every shingle owns a
region, as wide as its weight and open upwards, in which a hash throws darts
with density one: each dart has a height and a coordinate of the signature,
and a coordinate keeps its earliest (lowest) dart. Two documents keep the
same dart with a probability equal to their weighted Jaccard similarity. Only
as many rows of the region are thrown as fill all coordinates, about
``k ln k`` darts for a signature of ``k``, however many shingles there are.

Equal texts are one class from the start. Within a bucket of equal bands each
member is held against the bucket's first text by an exact check of the
similarity, which settles copies and near copies without pairs among them.
Members that no chain of links joins to that text are compared with all members
of their bucket, in blocks of bounded size, whose shingles come along: a task
counts what the sets of a block share, exactly, and emits a link only where it
joins two classes, so at most one less than the block has members. No pair of
a bucket is left out and none is listed. Links are joined to classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from loadcast.llm.components import components, written
from loadcast.llm.text import WordHashes, mix, shingles, uniform
from loadcast.llm.workers import map_arrow

SHINGLE = 5
SIMILARITY = 0.8

#: A pair at similarity 0.8 shares a band with probability 0.9993, one at 0.5 with 0.31.
BANDS, ROWS = 24, 6

#: Members of a bucket that are compared at once, and bytes of their shingles.
BLOCK, BLOCK_BYTES = 1000, 32 << 20

#: Different shingles of a block that are counted at once.
COLUMNS = 2048

#: Poisson(1) distribution, as 64-bit thresholds: the number of darts in a unit of area.
DARTS = np.array([int(2**64 * p) for p in np.cumsum([math.exp(-1) / math.factorial(n) for n in range(12)])], np.uint64)

GOLD = np.uint64(0x9E3779B97F4A7C15)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates; ``elements`` are different 64-bit hashes."""
    total = float(weights.sum())
    columns = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), columns)
    column = np.arange(len(owner)) - np.repeat(np.cumsum(columns) - columns, columns)
    base = mix(elements[owner] + mix(np.uint64(seed) + column.astype(np.uint64) * GOLD))
    width = np.minimum(weights[owner] - column, 1.0)  # of the element's region within the column
    whole = bool((width >= 1.0).all())
    signature = np.zeros(k, np.uint64)
    empty = np.ones(k, bool)
    low, high = 0, max(1, math.ceil(k * (math.log(k) + 1.5) / total))
    while True:
        heights = np.repeat(np.arange(low, high, dtype=np.uint64), len(base))
        cell = mix(np.tile(base, high - low) + heights * GOLD) if high > 1 else mix(base)
        n = np.searchsorted(DARTS, cell, side="right")
        at = np.repeat(np.arange(len(cell)), n)
        nth = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(cell[at] + nth.astype(np.uint64) * GOLD)
        height = heights[at] + uniform(dart)
        coordinate = (mix(dart + GOLD) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
        if not whole:
            inside = uniform(mix(dart ^ GOLD)) < width[at % len(base)]
            dart, height, coordinate = dart[inside], height[inside], coordinate[inside]
        # From the highest to the lowest, so that the earliest dart of a coordinate stays.
        order = np.argsort(-height)
        hit = np.zeros(k, bool)
        hit[coordinate] = True
        lowest = np.zeros(k, np.uint64)
        lowest[coordinate[order]] = dart[order]
        new = empty & hit
        signature[new] = lowest[new]
        empty &= ~hit
        if not empty.any():
            return signature
        low, high = high, high + max(1, (high - low + 1) // 2)


def weighted_shingles(words: np.ndarray, size: int, counted: bool):
    """Different shingles, ascending, and their weights: 1, or with ``counted`` their numbers."""
    found, counts = np.unique(shingles(words, size), return_counts=True)
    return found, counts.astype(float) if counted else np.ones(len(found))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * GOLD + signature.reshape(bands, rows)[:, k])
    return out.view(np.int64)


def elements(words: np.ndarray, size: int, counted: bool) -> np.ndarray:
    """The shingles as an ascending set, ``counted`` ones once for each of their occurrences.

    The plain similarity of two such sets is the weighted one of the shingles.
    """
    found, counts = weighted_shingles(words, size, counted)
    if not counted:
        return found
    n = counts.astype(np.int64)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(mix(np.repeat(found, n) + nth.astype(np.uint64) * GOLD))


def jaccard(a, wa, b, wb) -> float:
    """Weighted Jaccard similarity of two ascending shingle arrays."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(wa[i], wb[j]).sum()
    return float(shared / (wa.sum() + wb.sum() - shared))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as ascending arrays, reach the similarity."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) >= similarity


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                 counted: bool = False) -> DataFrame:
    """(id, class_id): one row per row of ``docs``; the class is named by its smallest id.

    Documents are in a class if a chain of pairs at or above ``similarity``
    leads from one to the other. Texts that differ in white space only are
    equal; a text of fewer than five words is one shingle. Null texts and ones
    without words are like no other: their class is their own id. Null ids
    have a null class; rows with the same id are one document. Ids are integers.
    """
    def sketch(batches):
        known = WordHashes()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = known.of(text or "")
                if not len(words):
                    out.append((None, None))
                    continue
                signature = dart_signature(*weighted_shingles(words, size, counted), bands * rows)
                out.append((xxhash.xxh3_128_digest(words.tobytes()), band_keys(signature, bands, rows)))
            same, keys = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                             ["id", "same", "bands"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = written(map_arrow(texts, sketch, "id long, same binary, bands array<long>"), "sketches")
    with_words = sketches.where("id is not null and same is not null")
    firsts = written(with_words.groupBy("same").agg(F.min(F.struct("id", "bands")).alias("first"))
                     .select("same", "first.*", F.monotonically_increasing_id().alias("key")), "firsts")
    links = near_links(texts, firsts, size, similarity, counted)
    # A text's first id may be that of other rows too, when ids repeat: their texts share a class.
    again = (with_words.join(firsts.select("same", F.col("id").alias("b")), "same").where("id <> b")
             .select(F.col("id").alias("a"), "b"))
    roots = components(links.unionByName(again))
    ids = docs.select(F.col(id_col).cast("long").alias("node"), F.col(id_col).alias("own"))
    return ids.join(roots, "node", "left").select(F.col("own").alias(id_col), F.coalesce("root", "node").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one document of each class, the one of the smallest id.

    Of rows with the same id the one of the smallest text stays; rows with a null id all stay.
    """
    kept = near_classes(docs, id_col, text_col, **options).where(F.col("class_id") == F.col(id_col)).select(id_col).distinct()
    nth = "nth"
    while nth in docs.columns:
        nth += "_"
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    rows = docs.join(kept, id_col, "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return rows.unionByName(docs.where(F.col(id_col).isNull())).select(*(F.col(f"`{c}`") for c in docs.columns))


def block_links(ids: np.ndarray, roots: np.ndarray, sets: list, first: np.ndarray, similarity: float):
    """Links (a, b) that join classes of a block's members, or of a block (``first``) and another.

    What two sets share is counted over the shingles that more than one member
    holds. A link is taken only between members whose classes, given by their
    roots, no earlier link has joined.
    """
    side = np.flatnonzero(first)
    other = side if first.all() else np.flatnonzero(~first)
    if len(np.unique(roots)) < 2 or not len(other):
        return []
    sizes = np.array([len(s) for s in sets])
    held = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, holders = np.unique(held, return_inverse=True, return_counts=True)
    common = holders > 1
    owner, column = owner[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(side), len(other)), np.float32)
    total = int(common.sum())
    for low in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        holds = np.zeros((len(sets), min(COLUMNS, total - low)), np.float32)
        holds[owner[a:b], column[a:b] - low] = 1
        shared += holds[side] @ holds[other].T
    both = sizes[side][:, None] + sizes[other][None, :] - shared.astype(np.float64)
    passed = shared / both >= similarity
    label, found = roots.copy(), []
    for x, row in zip(side, passed, strict=True):
        near = other[row]
        for y in near[label[near] != label[x]]:
            if label[y] != label[x]:
                found.append((ids[x], ids[y]))
                label[label == label[y]] = label[x]
    return found


def group_links(batches, similarity: float):
    """Verified links (id, lead) of rows (band, i, j, first, id, root, s), which come sorted by group (band, i, j)."""
    def listed(rows):
        first, ids, roots, sets = zip(*rows, strict=True)
        found = block_links(np.array(ids), np.array(roots), [np.frombuffer(s, np.uint64) for s in sets], np.array(first, bool), similarity)
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["id", "lead"])

    group, rows = None, []
    for batch in batches:
        for *own, first, key, root, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != group:
                if rows:
                    yield from listed(rows)
                group, rows = own, []
            rows.append((first, key, root, s))
    if rows:
        yield from listed(rows)


def unjoined(members: DataFrame, found: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Verified links (id, lead) between ``members`` of a bucket that no chain of ``links`` joins."""
    classes = written(components(links), "classes")
    placed = (members.join(classes.withColumnRenamed("node", "id"), "id", "left")
              .select("band", "id", "lead", F.coalesce("root", "id").alias("root")))
    heads = placed.where("id = lead").select("band", F.col("root").alias("head"))
    sized = found.select("id", F.length("s").alias("bytes"))
    placed = placed.join(heads, "band").join(sized, "id").select("band", "id", "root", "bytes", (F.col("root") == F.col("head")).alias("joined"))

    def blocks(kind):
        rows, size = F.count_if(kind), F.sum(F.when(kind, F.col("bytes")).otherwise(0))
        return F.greatest(F.ceil(rows / BLOCK), F.least(rows, F.ceil(size / BLOCK_BYTES))).cast("int")

    mixed = placed.groupBy("band").agg(blocks(~F.col("joined")).alias("loose"), blocks(F.col("joined")).alias("tied")).where("loose > 0")
    # Blocks of a bucket, those of members in the lead's class last; each pair of blocks is a group
    # of its own. Only pairs of members that are both in the lead's class are not looked at.
    place = F.when(F.col("joined"), F.col("loose") + F.pmod(F.xxhash64("id"), "tied")).otherwise(F.pmod(F.xxhash64("id"), "loose"))
    others = F.when(F.col("joined"), F.col("loose")).otherwise(F.col("loose") + F.col("tied"))
    groups = (placed.join(mixed, "band").select("band", "id", "root", place.cast("int").alias("block"), others.alias("others"))
              .join(found, "id")
              .select("band", "id", "root", "s", "block", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
              .select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      (F.col("block") <= F.col("other")).alias("first"), "id", "root", "s"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j", "first", "id")
    return map_arrow(groups, lambda batches: group_links(batches, similarity), "id long, lead long").distinct()


def near_links(texts: DataFrame, firsts: DataFrame, size: int, similarity: float, counted: bool) -> DataFrame:
    """Verified links (a, b) between the first documents (id, same, key, bands) of the different texts.

    An id may be the first of several texts: up to the links, a text goes by its own key.
    """
    keys = firsts.select("id", "same", "key")
    banded = firsts.select(F.col("key").alias("id"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = written(banded.join(shared, "band"), "members")

    def sets(batches):
        known = WordHashes()
        for batch in batches:
            words = [known.of(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in words], pa.binary()),
                 pa.array([elements(w, size, counted).tobytes() for w in words], pa.binary())], ["id", "same", "s"])

    # The number of documents in buckets has no bound, so they are not broadcast to the texts.
    asked = keys.join(members.select(F.col("id").alias("key")).distinct(), "key", "left_semi")
    wanted = texts.join(asked.select("id").distinct().hint("merge"), "id", "left_semi").dropna()
    found = map_arrow(wanted, sets, "id long, same binary, s binary").dropDuplicates(["id", "same"])
    found = written(found.join(asked, ["id", "same"]).select(F.col("key").alias("id"), "s"), "shingles")

    def verify(batches):
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ok = [alike(np.frombuffer(s, np.uint64), np.frombuffer(s2, np.uint64), similarity) for s, s2 in pairs]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    # Each member against its buckets' first texts: a text has one partner a band at most.
    pairs = members.where("id <> lead").select("id", "lead").distinct()
    sides = pairs.join(found, "id").join(found.select(F.col("id").alias("lead"), F.col("s").alias("s2")), "lead")
    ends = [F.col("id").alias("a"), F.col("lead").alias("b")]
    links = written(map_arrow(sides.select("id", "lead", "s", "s2"), verify, "id long, lead long"), "links").select(*ends)
    links = links.unionByName(unjoined(members, found, links, similarity).select(*ends))
    a, b = (keys.select(F.col("key").alias(k), F.col("id").alias(f"id_{k}")) for k in "ab")
    return links.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
