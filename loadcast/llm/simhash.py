"""Operator 6: SimHash fingerprints, and a search for near fingerprints.

A term is a word with the word before it, so that documents which merely
share frequent words are not alike. Each term's hash votes on every bit with
the weight ``1 + ln(count)``; the sign of the votes is the fingerprint. The
likeness of two fingerprints is the share of equal bits.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadcast.llm.text import WordHashes, mix
from loadcast.llm.workers import map_arrow
from loadcast.session import scratch_path

BITS = 128


def fingerprint(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The packed bits of a text's word hashes; a text without words has no bit set."""
    if not len(words):
        return np.zeros(bits // 8, np.uint8)
    pairs = words.copy()
    pairs[1:] += mix(words[:-1])
    pairs[0] += np.uint64(1)
    terms, counts = np.unique(mix(pairs), return_counts=True)
    weights = (1.0 + np.log(counts)).astype(np.float32)
    hashes = np.empty((len(terms), bits // 64), "<u8")
    for k in range(bits // 64):
        hashes[:, k] = mix(terms + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
    votes = np.zeros(bits, np.float32)
    half = weights.sum() / 2
    for at in range(0, len(terms), 8192):
        spread = np.unpackbits(hashes[at : at + 8192].view(np.uint8), axis=1)
        votes += weights[at : at + 8192] @ spread
    return np.packbits(votes > half)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / (8 * len(a))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, fingerprint binary) of every whole text; null and empty texts have no bit set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        known = WordHashes()
        for batch in batches:
            found = [fingerprint(known.of(t or ""), bits).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["key", "fingerprint"])

    picked = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(picked, rows, f"key {kind}, fingerprint binary").withColumnRenamed("key", id_col)


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int | None = None,
                      bits: int = BITS) -> DataFrame:
    """All pairs of different fingerprints within a Hamming radius, by permuted block tables.

    The bits are cut into ``blocks`` (default: radius + 2) and there is one table for each
    choice of ``blocks - radius`` of them, keyed by their bits: two fingerprints
    within the radius agree on one choice at least, so none is missed. Equal
    fingerprints are one row of every table, however many documents have them;
    a pair is emitted by the first table that holds it only.

    ``prints`` has a binary column ``fingerprint``; null ones take no part.
    Returns (a, b, distance) with a < b. The pairs are the answer itself, so
    choose a radius at which a document has few different neighbours.
    """
    blocks = blocks or radius + 2
    distinct = prints.select("fingerprint").where("fingerprint is not null").distinct()
    edges = [bits * k // blocks for k in range(blocks + 1)]
    text = F.concat(*(F.lpad(F.conv(F.hex(F.substring("fingerprint", k + 1, 4)), 16, 2), 32, "0")
                      for k in range(0, bits // 8, 4)))
    spelled = distinct.withColumn("bits", text)
    choices = list(combinations(range(blocks), blocks - radius))
    part = [F.substring("bits", edges[k] + 1, edges[k + 1] - edges[k]) for k in range(blocks)]
    tables = F.array(*(F.concat(F.lit(f"{n}:"), *(part[k] for k in c)) for n, c in enumerate(choices)))
    rows = spelled.select("fingerprint", "bits", F.posexplode(tables).alias("n", "block"))
    a, b = rows.alias("a"), rows.alias("b")
    words = [F.bit_count(F.conv(F.substring("a.bits", k + 1, 32), 2, 10).cast("long").bitwiseXOR(
        F.conv(F.substring("b.bits", k + 1, 32), 2, 10).cast("long"))) for k in range(0, bits, 32)]
    same = [F.substring("a.bits", edges[k] + 1, edges[k + 1] - edges[k])
            == F.substring("b.bits", edges[k] + 1, edges[k + 1] - edges[k]) for k in range(blocks)]
    first = F.coalesce(*(F.when(reduce(lambda x, y: x & y, (same[k] for k in c)), F.lit(n))
                         for n, c in enumerate(choices)))
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.fingerprint") < F.col("b.fingerprint")))
    return (pairs.where(F.col("a.n") == first)
            .select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"),
                    reduce(lambda x, y: x + y, words).alias("distance"))
            .where(F.col("distance") <= radius))


def edited(text: str, follower: str) -> str:
    """The text with its last half replaced by as many first code points of another."""
    n = len(text) // 2
    return text[: len(text) - n] + follower[:n]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Fingerprints of each text, of its edited text and its likeness to both neighbours' prints.

    The next document is the one before it by id (ties by the text's 64-bit
    hash; null ids come last and after the last the first). Null texts count as empty. Returns
    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint as hex,
    near_edited, near_next), one row per row; a lone document is its own next.

    Whole texts are shuffled once, by ranges of the id. Within a range each
    row sees its follower; the last row of a range waits for the first of the
    next one, and these few rows are put together afterwards.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Ranges are drawn from a sample of the order's columns at the driver, so texts are not among them.
    order = [F.col("key").desc_nulls_last(), F.col("th")]
    ranged = (docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
              .withColumn("th", F.xxhash64("text")).repartitionByRange(parts, *order)
              .sortWithinPartitions(*order).select("key", "text", F.spark_partition_id().alias("part")))
    fields = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = ["long", "string", "string", "string", "double", "double"]
    schema = ", ".join([f"key {kind}", *(f"{a} {b}" for a, b in zip(fields, types, strict=True))])

    def judge(known, text, follower, own, following):
        new = edited(text, follower)
        other = fingerprint(known.of(new), bits)
        return (len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes().hex(),
                other.tobytes().hex(), likeness(own, other), likeness(own, following))

    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def record(key_type, keys, found, part=None, head=None, tail=None):
        columns = list(zip(*found, strict=True)) or [[]] * len(arrow)
        out = [pa.array(keys, key_type), *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))]
        names = ["key", *fields]
        if part is not None:
            out += [pa.array(part, pa.int32()), pa.array(head, pa.string()), pa.array(tail, pa.string())]
            names += ["part", "head", "tail"]
        return pa.RecordBatch.from_arrays(out, names)

    nothing = (None,) * len(arrow)

    def rows(batches):
        known, last, first = WordHashes(), None, None
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, found = [], []
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = fingerprint(known.of(text), bits)
                if last is None:
                    first = text
                else:
                    keys.append(last[0])
                    found.append(judge(known, last[1], text, last[2], own))
                last = (key, text, own)
            n = len(keys)
            yield record(key_type, keys, found, [part] * n, [None] * n, [None] * n)
        if last is not None:
            yield record(key_type, [last[0]], [nothing], [part], [first], [last[1]])

    path = scratch_path(spark, "simhash")
    map_arrow(ranged, rows, f"{schema}, part int, head string, tail string").write.parquet(path)
    stored = spark.read.parquet(path)
    done = stored.where("tail is null").drop("part", "head", "tail")
    # One row per range: the next range that has rows, and after the last the first.
    ends = stored.where("tail is not null").select("key", "part", "head", "tail")
    parts_of = ends.select("part", "head")
    heads = parts_of.select(F.col("part").alias("next_part"), F.col("head").alias("follower"))
    following = ends.select("part").agg(F.sort_array(F.collect_list("part")).alias("all"))
    links = (following.select("all", F.posexplode("all").alias("at", "part"))
             .select("part", F.col("all")[(F.col("at") + 1) % F.size("all")].alias("next_part")))
    closing = ends.select("key", "part", "tail").join(links, "part").join(heads, "next_part").select("key", "tail", "follower")

    def close(batches):
        known = WordHashes()
        for batch in batches:
            found = []
            for text, follower in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(judge(known, text, follower, fingerprint(known.of(text), bits),
                                   fingerprint(known.of(follower), bits)))
            yield record(batch.schema.field(0).type, batch.column(0).to_pylist(), found)

    return done.unionByName(map_arrow(closing, close, schema)).withColumnRenamed("key", id_col)
