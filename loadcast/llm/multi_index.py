"""Operator 2: approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook; a cell
is a pair of centroids. A query visits cells in the order of the summed
distance of its halves to the two centroids (for inner products: the negated
inner product), taken from a heap over the sorted pairs, until the cells hold
enough vectors; these are then scored exactly.

Equal vectors are one entry of the index with the smallest ids that could be
among the nearest, so a vector that a third of all rows share costs one
entry and one search. Cells form blocks of bounded size, and a
task scores one block against a bounded share of the queries that visit it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from loadcast.llm.workers import map_arrow
from loadcast.session import scratch_path

#: Vectors that codebooks are learned from at most; the sample does not grow further.
SAMPLE = 20_000

#: Centroids of each half.
CENTROIDS = 64

#: Vectors that a query's cells hold at least: PROBED, or PROBED_SHARE of all. Vectors without
#: clusters need this much for a recall above 0.9; clustered ones do with far less.
PROBED = 3000
PROBED_SHARE = 0.45

#: Vectors, and queries, of one block.
BLOCK = 8192


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: its nearest centroids, by Euclidean distance."""
        half = self.first.shape[1]
        a, b = nearest(x[:, :half], self.first), nearest(x[:, half:], self.second)
        return a * len(self.second) + b

    def visit(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """Cells in ascending summed distance until they hold ``enough`` vectors."""
        half = self.first.shape[1]
        a, b = -self.first @ q[:half], -self.second @ q[half:]
        rows, cols = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen, out, held = [(a[rows[0]] + b[cols[0]], 0, 0)], {(0, 0)}, [], 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(rows[i]) * len(b) + int(cols[j])
            if sizes[cell]:
                out.append(cell)
                held += sizes[cell]
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(heap, (a[rows[i2]] + b[cols[j2]], i2, j2))
        return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * x @ centroids.T, axis=1)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centroids = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        counts = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            sums = np.bincount(own, weights=x[:, d], minlength=k)
            centroids[counts > 0, d] = sums[counts > 0] / counts[counts > 0]
    return centroids


def usable(frame: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a finite, non-zero vector without nulls."""
    v = F.col("v")
    fit = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(
        v, lambda x: x != 0)
    return (frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fit)
            .select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           centroids: int = CENTROIDS, sample: int = SAMPLE, probed: int = PROBED,
           probed_share: float = PROBED_SHARE) -> DataFrame:
    """Each query's ``k`` nearest other rows by inner product: query_id, rank, <id>, score.

    ``is_query`` is a condition on the column ``id``. Nearest first, ties to
    the smaller id; all candidates where there are fewer. Null ids, and null,
    empty, zero or non-finite vectors or ones with null components, take no
    part, nor do vectors of another length than the most frequent one (ties:
    the longest). A repeated id is as many candidates. Empty tables give an
    empty result. Codebooks are learned from a bounded sample; every row is
    indexed.
    """
    spark = vectors.sparkSession
    schema = f"query_id long, rank int, {id_col} long, score double"
    every = usable(vectors, id_col, vector_col)
    lengths = every.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    width = lengths["d"]
    every = every.where(F.size("v") == width)

    # One entry per distinct vector: its k + 1 smallest ids; whether a query has it.
    ranked = every.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id")))
    small = ranked.where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    queries = every.where(is_query).select("id", "v")
    asked = queries.select("v").distinct().withColumn("asked", F.lit(True))
    entries = small.join(asked, "v", "left").select(F.xxhash64("v").alias("hash"), F.col("ids")[0].alias("entry"), "v", "ids",
                                                    F.coalesce("asked", F.lit(False)).alias("asked"))
    path = scratch_path(spark, "multi-index-entries")
    entries.write.parquet(path)
    entries = spark.read.parquet(path)
    total = entries.count()

    place = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    drawn = entries.where(place < sample / total).select("v").toPandas()["v"].to_list()
    if len(drawn) < min(total, 2 * centroids):
        drawn = entries.orderBy("hash", "entry").limit(sample).select("v").toPandas()["v"].to_list()
    x = np.array(drawn, float)
    x = x[np.lexsort(x.T[::-1])]
    half = (width + 1) // 2
    books = Codebooks(k_means(x[:, :half], centroids, 1), k_means(x[:, half:], centroids, 2)
                      if width > half else np.zeros((1, 0)))
    cells_there = len(books.first) * len(books.second)

    def place_rows(batches):
        for batch in batches:
            cell = books.cells(matrix(batch.column(1))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())],
                                             ["entry", "v", "ids", "asked", "cell"])

    placed = map_arrow(entries.select("entry", "v", "ids", "asked"), place_rows,
                       "entry long, v array<double>, ids array<long>, asked boolean, cell int")
    path = scratch_path(spark, "multi-index-cells")
    placed.write.parquet(path)
    placed = spark.read.parquet(path)
    sizes, asking = np.zeros(cells_there, np.int64), 0  # bounded by the codebooks
    for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked").cast("long")).alias("q")).collect():
        sizes[row["cell"]] = row["n"]
        asking += row["q"]
    enough = max(probed, int(probed_share * total), k + 1)
    # Neighbouring cells share a block; a cell beyond a block's size has several.
    first_block = (np.cumsum(sizes) - sizes) // BLOCK
    blocks = np.maximum(1, -(-sizes // BLOCK))
    first_block += np.cumsum(blocks - 1) - (blocks - 1)
    shares = max(1, -(-asking // BLOCK))

    def visit_rows(batches):
        for batch in batches:
            rows, block, cells = [], [], []
            for n, q in enumerate(matrix(batch.column(1))):
                by_block: dict[int, list[int]] = {}
                for cell in books.visit(q, sizes, enough):
                    for at in range(first_block[cell], first_block[cell] + blocks[cell]):
                        by_block.setdefault(int(at), []).append(cell)
                rows += [n] * len(by_block)
                block += by_block.keys()
                cells += by_block.values()
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(block, pa.int32()),
                 pa.array(cells, pa.list_(pa.int32()))], ["query", "q", "block", "cells"])

    asked_rows = map_arrow(placed.where("asked").select("entry", "v"), visit_rows,
                           "query long, q array<double>, block int, cells array<int>")
    asked_rows = asked_rows.withColumn("share", F.pmod(F.xxhash64("query"), F.lit(shares)).cast("int"))

    def block_rows(batches):
        for batch in batches:
            cell = batch.column(3).to_numpy()
            entry = batch.column(0).to_numpy(zero_copy_only=False)
            block = first_block[cell] + entry % blocks[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32())],
                                             ["entry", "v", "ids", "cell", "block"])

    held = map_arrow(placed.select("entry", "v", "ids", "cell"), block_rows,
                     "entry long, v array<double>, ids array<long>, cell int, block int")
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def score_block(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "id": [], "score": []}
        if len(there) and len(asking):
            there = there.sort_values("entry")
            x = np.array(there["v"].to_list(), float)
            ids, first = there["ids"].to_list(), there["entry"].to_numpy()
            names, cell = np.unique(there["cell"].to_numpy(), return_inverse=True)
            for at in range(0, len(asking), 256):
                part = asking.iloc[at : at + 256]
                visited = np.zeros((len(part), len(names)), bool)
                for row, cells in zip(visited, part["cells"], strict=True):
                    row[np.searchsorted(names, cells)] = True
                scores = np.where(visited[:, cell], np.array(part["q"].to_list(), float) @ x.T, -np.inf)
                for query, row in zip(part["query"], scores, strict=True):
                    least = np.partition(row, -(k + 1))[-(k + 1)] if len(row) > k + 1 else -np.inf
                    top = np.flatnonzero((row >= least) & (row > -np.inf))  # with every tie of the last place
                    top = top[np.lexsort((first[top], -row[top]))]
                    found = 0
                    for n, e in enumerate(top):
                        if found > k and row[e] < row[top[n - 1]]:
                            break
                        out["query"] += [query] * len(ids[e])
                        out["id"] += list(ids[e])
                        out["score"] += [row[e]] * len(ids[e])
                        found += len(ids[e])
        return pd.DataFrame(out).astype({"query": "int64", "id": "int64", "score": "float64"})

    found = (asked_rows.groupBy("block", "share").cogroup(held.groupBy("block", "share"))
             .applyInPandas(score_block, "query long, id long, score double"))
    # Distinct vectors first, then their queries, each without itself.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    lists = (found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
             .select("query", "id", "score"))
    askers = queries.join(entries.where("asked").select("v", F.col("entry").alias("query")), "v").select(
        F.col("id").alias("query_id"), "query")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (askers.distinct().join(lists, "query").where(F.col("id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
