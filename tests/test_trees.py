"""Boosted trees that keep directions: brute force, directions, interactions, missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcast.plans import models as md
from loadcast.plans import trees as tr


def planted(spark, n=4000, seed=1):
    """y rises with a, falls with b; a's slope depends on c, which has no sign."""
    r = np.random.default_rng(seed)
    a, b, c = r.uniform(0, 1, n), r.uniform(0, 1, n), r.integers(0, 2, n)
    y = 10 * a * c - 4 * b * (1 - c) + r.normal(0, 0.3, n)
    return spark.createDataFrame([(float(p), float(q), float(s), float(t)) for p, q, s, t in zip(a, b, c, y)],
                                 "a double, b double, c double, y double")


def mae(model, df):
    return model.transform(df).agg(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]


@pytest.fixture(scope="module")
def fitted(spark):
    return tr.fit_monotone_trees(planted(spark), ["a", "b", "c"], [1, -1, 0], label="y", learning_rate=0.3,
                                 max_depth=3, max_bins=16, refresh=4, patience=3)


def test_interactions_beat_the_additive_model(spark, fitted):
    additive = md.fit_monotone_boost(planted(spark), ["a", "b", "c"], [1, -1, 0], label="y")
    fresh = planted(spark, 2000, seed=2)
    assert mae(fitted, fresh) < 0.5 * mae(additive, fresh)


def test_directions_hold_on_a_grid(spark, fitted):
    ticks = np.linspace(-0.2, 1.2, 15)
    bins = fitted.binner().with_bins(spark.createDataFrame(
        [(float(a), float(b), float(c)) for a in ticks for b in ticks for c in (0, 1)],
        "a double, b double, c double")).select("_b0", "_b1", "_b2").toPandas().to_numpy().astype(int)
    p = tr.add_trees(fitted.trees, bins, fitted.missing, fitted.base).reshape(15, 15, 2)
    assert np.diff(p, axis=0).min() >= -1e-12 and np.diff(p, axis=1).max() <= 1e-12
    assert p.max() - p.min() > 5


def test_json_round_trip_and_shares(spark, fitted):
    again = tr.MonotoneTrees.from_json(fitted.to_json())
    few = planted(spark, 50, seed=3)
    assert [r.prediction for r in again.transform(few).collect()] == [r.prediction for r in fitted.transform(few).collect()]
    assert abs(sum(v for _, v in md.importances(fitted, fitted.features)) - 1) < 1e-9


def test_missing_values_go_where_they_gain(spark):
    df = planted(spark, 1500).withColumn("a", F.when(F.col("c") == 1, F.col("a"))) \
        .withColumn("y", F.when(F.col("a").isNull(), 50.0).otherwise(F.col("y")))
    m = tr.fit_monotone_trees(df, ["a", "b"], [1, -1], label="y", learning_rate=0.3, max_depth=3, patience=3)
    got = m.transform(spark.createDataFrame([(None, 0.5), (float("nan"), 0.5), (0.5, 0.5)], "a double, b double"))
    lacking, nan, there = [r.prediction for r in got.collect()]
    assert lacking == nan and abs(lacking - 50) < 5 and there < 15


def test_empty_constant_and_unlabelled(spark):
    schema = "a double, y double"
    for rows in ([], [(1.0, None), (2.0, float("nan"))]):
        with pytest.raises(ValueError, match="no training rows"):
            tr.fit_monotone_trees(spark.createDataFrame(rows, schema), ["a"], [1], label="y")
    for rows in ([(1.0, 3.0)] * 30, [(None, 3.0)] * 30):
        m = tr.fit_monotone_trees(spark.createDataFrame(rows, schema), ["a"], [1], label="y")
        assert not m.trees and m.base == 3.0


@pytest.mark.parametrize("sign", [-1, 0, 1])
def test_best_split_equals_brute_force(sign):
    r = np.random.default_rng(7)
    for _ in range(60):
        n = r.integers(0, 9, (1, 6)).astype(float)
        s = r.normal(0, 3, (1, 6)) * (n > 0)
        low, high = -1.0, float(r.uniform(-0.5, 2))
        got = tr.best_split(0, n, s, low, high, [sign], np.array([5]), 2)

        def loss(rows):
            w = min(max(s[0, rows].sum() / n[0, rows].sum(), low), high)
            return w, 2 * w * s[0, rows].sum() - n[0, rows].sum() * w * w

        options = []
        for cut in range(5):
            for side in ([5], []):
                left = [*range(cut + 1), *side]
                right = [i for i in range(6) if i not in left]
                if n[0, left].sum() < 2 or n[0, right].sum() < 2:
                    continue
                (wl, gl), (wr, gr) = loss(left), loss(right)
                if sign * (wr - wl) >= 0:
                    options.append(gl + gr - loss(list(range(6)))[1])
        best = max(options, default=0.0)
        assert (got.gain if got else 0.0) == pytest.approx(max(best, 0.0), abs=1e-6)


def test_leaves_are_bounded_and_gains_decide(spark):
    m = tr.fit_monotone_trees(planted(spark, 1500), ["a", "b", "c"], [1, -1, 0], label="y", learning_rate=0.5,
                              max_depth=4, max_leaves=3, patience=2)
    assert m.trees and all(sum(f >= 0 for f in t.feature) <= 2 for t in m.trees)


def test_a_pass_is_one_job_of_one_stage_and_sums_up_all_rows(spark, tmp_path):
    model = tr.MonotoneTrees(["a", "b"], [1, 0], [[0.5], [0.2, 0.7]], 2.0, label="y")
    few = planted(spark, 300).select("a", "b", "y").repartition(2)
    tr.pack(few, model, 0.0).coalesce(1).write.parquet(str(tmp_path / "packed"))
    packed = tr.blocks(spark.read.parquet(str(tmp_path / "packed")), 2)
    spark.sparkContext.setJobGroup("one pass", "")
    try:
        counts, sums, loss = tr.level_histogram(packed, 2.0, [], tr.Tree.stump(2), {0: 0}, model.missing, True)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        packed.unpersist()
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup("one pass")
    assert len(jobs) == 1 and len(tracker.getJobInfo(jobs[0]).stageIds) == 1
    rows = [(r.a, r.b, r.y) for r in few.collect()]
    assert loss == pytest.approx(sum((y - 2.0) ** 2 for _, _, y in rows))
    for j, edges in enumerate(model.edges):
        at = np.searchsorted(edges, [r[j] for r in rows], side="right")
        assert list(counts[0, j]) == list(np.bincount(at, minlength=counts.shape[2]))
        assert sums[0, j] == pytest.approx(np.bincount(at, [r[2] - 2.0 for r in rows], counts.shape[2]))


def test_histograms_of_tasks_add_up():
    a = (np.array([0, 3]), np.array([1.0, 2.0]), np.array([0.5, 1.0]), 2.0)
    b = (np.array([1, 3]), np.array([4.0, 1.0]), np.array([-1.0, 0.25]), 0.5)
    cells, n, r, loss = tr.add_histograms(a, b)
    assert [list(cells), list(n), list(r), loss] == [[0, 1, 3], [1.0, 4.0, 3.0], [0.5, -1.0, 1.25], 2.5]
    empty = (np.empty(0, np.int64), np.empty(0), np.empty(0), 1.0)
    assert [len(x) for x in tr.add_histograms(empty, empty)[:3]] == [0, 0, 0] and tr.add_histograms(a, empty)[3] == 3.0
