"""Boosted trees with interactions that keep monotone directions.

Rows are cut into quantile bins once and grouped by their whole bin vector:
``(bins, n, sum of y, sum of y^2)``. Everything after that reads distinct bin
vectors. A level of a tree is one pass: each task adds its vectors into a
histogram by (node, feature, bin) of at most ``nodes * features * bins`` cells,
whatever the rows. The histograms are summed by a tree of tasks and the driver
adds up the last few. A fit is hundreds of passes, so the vectors are kept as
arrays and a pass over few of them is one job of one stage, without a plan.

A node carries bounds for the values below it. A split on a signed feature is
taken only if its two values are in order, and their mean becomes the upper
bound of the lower side and the lower bound of the upper one. Two rows that
differ in one signed feature part at a split on it, so every tree keeps the
direction, whatever other features it splits on. A missing value has a bin of
its own and goes to the side where it gains more.

Rounds go on until the loss on held-out vectors has not fallen for
``patience`` trees; the trees up to the best round are kept.
"""

from __future__ import annotations

import json
import pickle
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.plans import models as md
from loadcast.session import remove_path, scratch_path

PACKED = "bins array<smallint>, n double, sy double, syy double, held boolean, pred double"


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i+1, 2i+2); ``feature`` -1 marks a leaf."""

    depth: int
    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    value: list[float]

    @staticmethod
    def stump(depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return Tree(depth, [-1] * size, [0] * size, [False] * size, [0.0] * size)

    def nodes(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The node that each bin vector has reached."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        to_left = np.array(self.missing_left)
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == missing[np.maximum(f, 0)], to_left[at], b <= cut[at])
            at = np.where(inner, 2 * at + 2 - left, at)
        return at

    def predict(self, bins: np.ndarray, missing: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins, missing)]


def add_trees(trees: list[Tree], bins: np.ndarray, missing: np.ndarray, start: np.ndarray | float) -> np.ndarray:
    out = np.zeros(len(bins)) + start
    for t in trees:
        out += t.predict(bins, missing)
    return out


@dataclass
class MonotoneTrees:
    """Base value plus trees over binned features; every sign holds by construction.

    A prediction takes null and NaN as missing. Rows keep their columns.
    """

    features: list[str]
    signs: list[int]
    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    gains: list[float] = field(default_factory=list)
    label: str = S.GAS_DEMAND

    @property
    def missing(self) -> np.ndarray:
        return np.array([len(e) + 1 for e in self.edges])

    def binner(self) -> md.MonotoneBoostModel:
        return md.MonotoneBoostModel(self.features, self.signs, self.edges, [], 0.0, [], self.label)

    def transform(self, df: DataFrame, out: str = "prediction",
                  overrides: dict[str, Column] | None = None, prefix: str = "_b") -> DataFrame:
        names = [f"{prefix}{j}" for j in range(len(self.features))]
        trees, missing, base = self.trees, self.missing, self.base

        def score(*cols: pd.Series) -> pd.Series:
            return pd.Series(add_trees(trees, np.column_stack(cols), missing, base))

        udf = F.pandas_udf(score, "double")
        binned = self.binner().with_bins(df, overrides, prefix)
        return binned.withColumn(out, udf(*[F.col(c).cast("int") for c in names])).drop(*names)

    def importances(self) -> list[tuple[str, float]]:
        total = sum(self.gains) or 1.0
        return [(f, g / total) for f, g in zip(self.features, self.gains)]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(s: str) -> MonotoneTrees:
        held = json.loads(s)
        return MonotoneTrees(**{**held, "trees": [Tree(**t) for t in held["trees"]]})


# --- the packed table ---------------------------------------------------------------

def pack(train: DataFrame, model: MonotoneTrees, held_share: float) -> DataFrame:
    """One row per distinct bin vector; a hash of the vector tells which are held out."""
    names = [F.col(f"_b{j}").cast("smallint") for j in range(len(model.features))]
    y = F.col(model.label).cast("double")
    rows = model.binner().with_bins(train.select(y.alias("_y"), *model.features))
    return (rows.select(F.array(*names).alias("bins"), "_y").groupBy("bins")
            .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("sy"),
                 F.sum(F.col("_y") * F.col("_y")).alias("syy"))
            .withColumn("held", F.pmod(F.xxhash64("bins"), F.lit(1000)) < int(held_share * 1000))
            .withColumn("pred", F.lit(0.0)))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("bins").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width).astype(np.int64)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def blocks(packed: DataFrame, width: int) -> RDD:
    """The packed table as blocks of arrays (bins, n, sy, syy, held, pred), one a batch of rows, kept for the passes."""
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                arrays = [column(batch, c) for c in ("n", "sy", "syy", "held", "pred")]
                block = pickle.dumps((matrix(batch, width).astype(np.int16), *arrays))
                yield pa.RecordBatch.from_pydict({"block": [block]})

    return (packed.mapInArrow(task, "block binary").rdd.map(lambda row: pickle.loads(row.block))
            .persist(StorageLevel.MEMORY_AND_DISK))


def add_histograms(a: tuple, b: tuple) -> tuple:
    """The sum of two histograms (cells in order, counts, residual sums, held-out loss)."""
    cells, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    n, r = (np.bincount(at, np.concatenate([a[k], b[k]]), len(cells)) for k in (1, 2))
    return cells, n, r, a[3] + b[3]


def level_histogram(packed: RDD, base: float, trees: list[Tree], tree: Tree, slots: dict[int, int],
                    missing: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts and residual sums by (slot of a node, feature, bin), and the held-out squared loss.

    ``trees`` are those whose values the blocks' ``pred`` does not hold yet.
    With ``both`` every vector serves for training and for the loss.
    """
    nf, width = len(missing), int(missing.max()) + 1
    size = len(slots) * nf * width
    slot_of = np.full(len(tree.feature), -1)
    slot_of[list(slots)] = list(slots.values())

    def task(some_blocks):
        n_sum, r_sum, loss = np.zeros(size), np.zeros(size), 0.0
        for bins, n, sy, syy, held, pred in some_blocks:
            bins = bins.astype(np.int64)
            now = add_trees(trees, bins, missing, pred + base)
            held = held | both
            loss += float((syy - 2 * now * sy + n * now * now)[held].sum())
            slot = slot_of[tree.nodes(bins, missing)]
            use = (slot >= 0) & (~held | both)
            bins, slot, n, r = bins[use], slot[use], n[use], (sy - n * now)[use]
            for j in range(nf):
                cell = (slot * nf + j) * width + bins[:, j]
                n_sum += np.bincount(cell, n, size)
                r_sum += np.bincount(cell, r, size)
        some = np.flatnonzero(n_sum)
        yield some, n_sum[some], r_sum[some], loss

    cell, n, r, loss = packed.mapPartitions(task).treeReduce(add_histograms)
    out = np.zeros((2, size))
    out[0, cell], out[1, cell] = n, r
    counts, sums = out.reshape(2, len(slots), nf, width)
    return counts, sums, loss


def with_trees(packed: DataFrame, trees: list[Tree], missing: np.ndarray) -> DataFrame:
    """The packed table with the values of ``trees`` added to ``pred``."""
    def task(batches):
        for batch in batches:
            pred = add_trees(trees, matrix(batch, len(missing)), missing, column(batch, "pred"))
            at = batch.schema.get_field_index("pred")
            yield batch.set_column(at, batch.schema.field(at), pa.array(pred))

    return packed.mapInArrow(task, PACKED)


# --- growing ------------------------------------------------------------------------

@dataclass
class Split:
    node: int
    feature: int
    cut: int
    missing_left: bool
    gain: float
    values: tuple[float, float]
    low: float
    high: float


def best_split(node: int, counts: np.ndarray, sums: np.ndarray, low: float, high: float,
               signs: list[int], missing: np.ndarray, min_rows: float) -> Split | None:
    """The split of a node with the largest fall of the squared loss, or None.

    Ties go to the first feature, to missing values on the left, to the lowest cut.
    """
    best = None
    n_all, r_all = counts[0].sum(), sums[0].sum()
    whole = np.clip(r_all / max(n_all, 1e-300), low, high)
    before = 2 * whole * r_all - n_all * whole * whole
    for j, sign in enumerate(signs):
        last = missing[j]
        for missing_left in (True, False):
            nl, rl = np.cumsum(counts[j, :last]), np.cumsum(sums[j, :last])
            if missing_left:
                nl, rl = nl + counts[j, last], rl + sums[j, last]
            nr, rr = n_all - nl, r_all - rl
            fits = (nl >= min_rows) & (nr >= min_rows)
            if not fits.any():
                continue
            wl = np.clip(np.divide(rl, nl, out=np.zeros_like(rl), where=nl > 0), low, high)
            wr = np.clip(np.divide(rr, nr, out=np.zeros_like(rr), where=nr > 0), low, high)
            fits &= sign * (wr - wl) >= 0
            gain = np.where(fits, 2 * wl * rl - nl * wl * wl + 2 * wr * rr - nr * wr * wr - before, -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > max(best.gain if best else 0.0, 1e-9 * abs(before)):
                best = Split(node, j, at, missing_left, float(gain[at]), (float(wl[at]), float(wr[at])), low, high)
    return best


def grow(histogram, signs: list[int], missing: np.ndarray, max_depth: int, max_leaves: int,
         min_rows: float) -> tuple[Tree, float, np.ndarray]:
    """One tree by levels; of a level's splits those with the largest gains, up to ``max_leaves``.

    ``histogram(tree, slots)`` is a pass over the data. Returns the tree (its
    values not shrunk yet), the held-out loss before it, and gains by feature.
    """
    tree, gains, loss, leaves = Tree.stump(max_depth), np.zeros(len(signs)), 0.0, 1
    active = {0: (-np.inf, np.inf)}
    for level in range(max_depth):
        slots = {node: i for i, node in enumerate(active)}
        counts, sums, held = histogram(tree, slots)
        loss = held if level == 0 else loss
        found = [best_split(node, counts[i], sums[i], *active[node], signs, missing, min_rows)
                 for node, i in slots.items()]
        taken = sorted((s for s in found if s), key=lambda s: (-s.gain, s.node))[:max(0, max_leaves - leaves)]
        if not taken:
            break
        leaves += len(taken)
        active = {}
        for s in taken:
            tree.feature[s.node], tree.cut[s.node], tree.missing_left[s.node] = s.feature, s.cut, s.missing_left
            left, right = 2 * s.node + 1, 2 * s.node + 2
            tree.value[left], tree.value[right] = s.values
            gains[s.feature] += s.gain
            middle = sum(s.values) / 2
            sign = signs[s.feature]
            active[left] = (middle if sign < 0 else s.low, middle if sign > 0 else s.high)
            active[right] = (middle if sign > 0 else s.low, middle if sign < 0 else s.high)
    return tree, loss, gains


def fit_monotone_trees(train: DataFrame, features: list[str], signs: list[int] | None = None,
                       label: str = S.GAS_DEMAND, learning_rate: float = 0.1, max_depth: int = 6,
                       max_leaves: int = 63, max_bins: int = 64, min_rows: int = 10, patience: int = 10,
                       tolerance: float = 1e-3, held_share: float = 0.2, refresh: int = 25) -> MonotoneTrees:
    """F3 with interactions: boosted trees that keep every sign.

    Rows without a label (null, NaN) take no part; no row left is a
    ``ValueError``. A round counts as progress if it lowers the held-out
    squared loss by ``tolerance`` of that of the mean; after ``patience``
    rounds without, fitting ends. Where the rows are too few to hold some out,
    all rows serve for both. Every ``refresh`` trees the table is written anew
    with their values, so that a pass evaluates that many trees at most, and
    the table before is deleted.
    """
    spark = train.sparkSession
    signs = md.monotone_signs(features) if signs is None else signs
    known = train.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    # A feature without any value still needs a cut point; its rows are all missing.
    edges = [e or [0.0] for e in md._quantile_edges(known, features, max_bins)]
    model = MonotoneTrees(features, list(signs), edges, 0.0, [], [0.0] * len(features), label)
    missing = model.missing

    path = scratch_path(spark, "packed")
    pack(known, model, held_share).write.parquet(path)
    parts = {r["held"]: r for r in spark.read.parquet(path).groupBy("held").agg(
        F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy")).collect()}
    if not parts:
        remove_path(spark, path)
        raise ValueError("no training rows")
    both = len(parts) < 2
    fit_part = next(iter(parts.values())) if both else parts[False]
    held_part = fit_part if both else parts[True]
    model.base = fit_part["sy"] / fit_part["n"]
    least = tolerance * max(0.0, held_part["syy"] - 2 * model.base * held_part["sy"]
                            + held_part["n"] * model.base ** 2)

    packed = blocks(spark.read.parquet(path), len(features))
    fresh: list[Tree] = []
    best, best_loss, gains = 0, np.inf, []
    try:
        while True:
            tree, loss, gain = grow(
                lambda t, slots: level_histogram(packed, model.base, fresh, t, slots, missing, both),
                model.signs, missing, max_depth, max_leaves, min_rows)
            if loss < best_loss - least:
                best, best_loss = len(model.trees), loss
            if tree.feature[0] < 0 or len(model.trees) - best >= patience:
                break
            tree.value = [learning_rate * v for v in tree.value]
            model.trees.append(tree)
            fresh.append(tree)
            gains.append(gain)
            if len(fresh) == refresh:
                after = scratch_path(spark, "packed")
                with_trees(spark.read.parquet(path), fresh, missing).write.parquet(after)
                packed.unpersist()
                remove_path(spark, path)
                path, fresh = after, []
                packed = blocks(spark.read.parquet(path), len(features))
    finally:
        packed.unpersist()
        remove_path(spark, path)
    model.trees = model.trees[:best]
    model.gains = [float(g) for g in sum(gains[:best], np.zeros(len(features)))]
    return model
