"""Change sets, ranges, upserts, profiling, models and the driver entry points."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from loadcast import schema as S
from loadcast.operators import changes as ch
from loadcast.operators import metrics as me
from loadcast.operators import profile as pr
from loadcast.plans import models as md


def _tables(spark):
    old = spark.createDataFrame([(i, f"v{i}", float(i)) for i in range(1, 11)],
                                "k long, a string, b double")
    new_rows = []
    for i in range(1, 11):
        if i in (2, 3, 4, 8, 9):
            new_rows.append((i, f"v{i}", float(i) + 0.5))
        elif i == 6:
            continue  # deleted
        else:
            new_rows.append((i, f"v{i}", float(i)))
    new_rows.append((12, "new", None))
    new = spark.createDataFrame(new_rows, "k long, a string, b double")
    return old, new


def test_changed_rows_kinds_and_ranges(spark):
    old, new = _tables(spark)
    d = ch.changed_rows(new, old, ["k"])
    kinds = {r.k: r.kind for r in d.collect()}
    assert [k for k, v in sorted(kinds.items()) if v == "update"] == [2, 3, 4, 8, 9]
    assert kinds[6] == "delete" and kinds[12] == "insert" and kinds[1] == "same"
    cols = rows(ch.changed_columns(d))
    assert cols == [{"column_name": "b", "n_changed": 5}]
    upd = d.where("kind = 'update'").select("k")
    got = rows(ch.group_consecutive(upd, "k"), ["range_start"])
    assert [(r["range_start"], r["range_end"], r["n_rows"]) for r in got] == [(2, 4, 3), (8, 9, 2)]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_group_consecutive_matches_brute_force(spark, parts):
    rnd = random.Random(parts)
    keys = sorted({rnd.randint(-30, 120) for _ in range(90)} | set(range(40, 60)))
    df = spark.createDataFrame([(k, "g" if k % 2 else "h") for k in keys], "n long, grp string")
    # brute force per group
    want = set()
    for g in ("g", "h"):
        ks = [k for k in keys if ("g" if k % 2 else "h") == g]
        # consecutive in value: within a parity group values differ by 2, so
        # every group is all singletons; check the global grouping below too
        for k in ks:
            want.add((g, k, k, 1))
    got = {(r.grp, r.range_start, r.range_end, r.n_rows) for r in
           ch.group_consecutive(df, "n", keys=["grp"], num_partitions=parts).collect()}
    assert got == want
    runs, start, prev = [], keys[0], keys[0]
    for k in keys[1:]:
        if k != prev + 1:
            runs.append((start, prev, prev - start + 1))
            start = k
        prev = k
    runs.append((start, prev, prev - start + 1))
    got_all = {(r.range_start, r.range_end, r.n_rows) for r in
               ch.group_consecutive(df.select("n"), "n", num_partitions=parts).collect()}
    assert got_all == set(runs)


def test_upsert_applies_changes_and_is_idempotent(spark):
    old, new = _tables(spark)
    d = ch.changed_rows(new, old, ["k"])
    once = ch.upsert(old, d, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, new.collect()))
    twice = ch.upsert(once, d, ["k"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_exact_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(3)
    a = rnd.normal(size=501)
    b = rnd.integers(0, 7, size=200).astype(float)
    df = spark.createDataFrame([(float(x), None) for x in a] + [(None, float(y)) for y in b],
                               "a double, b double")
    d = {r.column_name: r for r in pr.describe(df, ["a", "b"]).collect()}
    for name, arr in (("a", a), ("b", b)):
        q = np.percentile(arr, [25, 50, 75])
        assert d[name]["count"] == len(arr)
        assert np.allclose([d[name]["p25"], d[name]["p50"], d[name]["p75"]], q)
        assert np.isclose(d[name]["std"], arr.std(ddof=1))


def test_null_and_value_counts(spark):
    df = spark.createDataFrame([("x", None), ("x", 1.0), (None, 2.0)], "s string, v double")
    assert sorted((r.column_name, r.n_null) for r in pr.null_counts(df).collect()) == \
        [("s", 1), ("v", 1)]
    vc = pr.value_counts(df, ["s"]).collect()
    assert [(r.value, r["count"]) for r in vc] == [("x", 2)]


def test_profile_range(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 3, 1),)], "date date")
    r = pr.profile_range(df).first()
    assert (r.n_rows, r.n_columns, r.min_date, r.max_date) == \
        (2, 1, dt.date(2024, 1, 2), dt.date(2024, 3, 1))


def test_r2_conventions(spark):
    df = spark.createDataFrame([("s", 1.0, 1.0), ("s", 1.0, 1.0), ("t", 1.0, 2.0),
                                ("t", 1.0, 0.0), ("u", 1.0, 3.0), ("u", 3.0, 1.0)],
                               "series_id string, y double, p double")
    got = {r.series_id: (r.mae, r.r2) for r in me.regression_metrics(df, "y", "p").collect()}
    assert got["s"] == (0.0, 1.0)
    assert got["t"] == (1.0, 0.0)
    assert got["u"] == (2.0, -3.0)


def test_pava_is_monotone_and_optimal_on_small_case():
    out = md.pava(np.array([1.0, 3.0, 2.0, 4.0]), np.array([1.0, 1.0, 1.0, 1.0]))
    assert list(out) == [1.0, 2.5, 2.5, 4.0]
    dec = md.pava(np.array([1.0, 3.0, 2.0]), np.ones(3), increasing=False)
    assert all(dec[i] >= dec[i + 1] for i in range(2))


def test_monotone_boost_is_monotone_in_signed_features(spark):
    rnd = np.random.default_rng(0)
    n = 600
    x1, x2, x3 = rnd.uniform(0, 10, n), rnd.uniform(0, 10, n), rnd.uniform(0, 10, n)
    y = 3 * x1 - 2 * x2 + np.sin(x3) * 5 + rnd.normal(0, 1, n)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t))
                                for a, b, c, t in zip(x1, x2, x3, y)], "a double, b double, c double, y double")
    m = md.fit_monotone_boost(df, ["a", "b", "c"], [1, -1, 0], label="y", rounds=200,
                              learning_rate=0.1, max_bins=32)
    grid = spark.createDataFrame([(float(v), 5.0, 5.0) for v in np.linspace(-1, 11, 40)],
                                 "a double, b double, c double")
    pa = [r.prediction for r in m.transform(grid).orderBy("a").collect()]
    assert all(pa[i] <= pa[i + 1] + 1e-12 for i in range(len(pa) - 1))
    gridb = grid.select(F.lit(5.0).alias("a"), F.col("a").alias("b"), "c")
    pb = [r.prediction for r in m.transform(gridb).orderBy("b").collect()]
    assert all(pb[i] >= pb[i + 1] - 1e-12 for i in range(len(pb) - 1))
    pred = m.transform(df).select("y", "prediction")
    r2 = me.regression_metrics(pred, "y", "prediction", keys=[]).first().r2
    assert r2 > 0.8
    assert md.MonotoneBoostModel.from_json(m.to_json()).tables == m.tables


def test_checkpoint_root_is_set(spark):
    from loadcast.session import checkpoint_root
    assert checkpoint_root(spark)


def test_forest_ensemble_predicts_and_round_trips(spark, tmp_path):
    rnd = np.random.default_rng(1)
    x = rnd.uniform(0, 10, 300)
    df = spark.createDataFrame([(float(a), float(2 * a + rnd.normal())) for a in x],
                               "a double, max_demand double")
    m = md.fit_demand_forest(df, ["a"], num_trees=10, max_depth=5, parallelism=4)
    assert isinstance(m, md.ForestEnsemble) and sum(m.weights) == 10
    pred = m.transform(df)
    assert "features" not in pred.columns
    r2 = me.regression_metrics(pred, "max_demand", "prediction", keys=[]).first().r2
    assert r2 > 0.9
    assert abs(sum(v for _, v in md.importances(m, ["a"])) - 1.0) < 1e-9
    m.save(str(tmp_path / "forest"))
    back = md.ForestEnsemble.load(spark, str(tmp_path / "forest"))
    a = sorted(r.prediction for r in m.transform(df).collect())
    b = sorted(r.prediction for r in back.transform(df).collect())
    assert np.allclose(a, b)


def test_write_upsert_round_trip(spark, tmp_path):
    old, new = _tables(spark)
    base = str(tmp_path / "base")
    old.write.parquet(base)
    d = ch.changed_rows(new, old, ["k"])
    out = ch.write_upsert(base, d, ["k"], str(tmp_path / "v2"))
    got = sorted(map(tuple, spark.read.parquet(out).select("k", "a", "b").collect()))
    assert got == sorted(map(tuple, new.collect()))


def test_supplied_weekday_text_does_not_break_one_hots(spark):
    from loadcast.operators import features as fe
    df = spark.createDataFrame([("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i, "월요일")
                                for i in range(10)],
                               "series_id string, date date, max_demand double, weekday_name string")
    out = fe.build_features(df)
    assert all(sum(r[c] for c in S.DOW_COLUMNS) == 1 for r in out.collect())


def test_forest_search_candidates():
    draws = md.sample_grid()
    assert len(draws) == 6 and len({tuple(sorted(d.items(), key=str)) for d in draws}) == 6
    assert draws[0] == {"numTrees": 300, "maxDepth": 16, "minInstancesPerNode": 4}
    assert all(d["numTrees"] in (100, 200, 300) for d in draws)


def test_forest_does_not_depend_on_cores_or_layout(spark, tmp_path):
    assert md.split_trees(100, 8) == [13, 13, 13, 13, 12, 12, 12, 12]
    assert md.split_trees(3, 8) == [1, 1, 1]
    rnd = np.random.default_rng(2)
    x = rnd.uniform(0, 10, 300)
    df = spark.createDataFrame([(float(a), float(2 * a + rnd.normal())) for a in x],
                               "a double, max_demand double")
    got = []
    for slots, parts in ((1, 1), (2, 3), (4, 6)):
        m = md.fit_demand_forest(df.repartition(parts), ["a"], num_trees=12, max_depth=4,
                                 parallelism=slots)
        assert isinstance(m, md.ForestEnsemble)
        got.append([r.prediction for r in m.transform(df.orderBy("a")).collect()])
    assert got[0] == got[1] == got[2]
    m.save(str(tmp_path / "f"))
    m.save(str(tmp_path / "f"))  # a rerun overwrites
    back = md.ForestEnsemble.load(spark, str(tmp_path / "f"))
    assert [r.prediction for r in back.transform(df.orderBy("a")).collect()] == got[0]


def test_fit_input_partitions_follow_rows_only(spark):
    df = spark.range(1000).selectExpr("cast(id as double) a", "cast(id as double) y").repartition(6)
    for per, want in ((100, 10), (1000, 1), (10_000, 1)):
        data = md.fit_input(df, ["a"], "y", rows_per_partition=per)
        assert data.rdd.getNumPartitions() == want and data.count() == 1000


def test_short_series_cannot_be_tuned(spark):
    df = spark.createDataFrame([("s", dt.date(2024, 1, i + 1), 1.0, 2.0) for i in range(3)],
                               "series_id string, date date, a double, max_demand double")
    with pytest.raises(md.NoFoldRows):
        md.tune_forest(df, ["a"], n_draws=1)


def test_gas_trees_impute_and_mark_missing_features(spark):
    rnd = np.random.default_rng(5)
    data = []
    for i in range(400):
        x, z = float(rnd.uniform(0, 1)), float(rnd.uniform(0, 1))
        y = 5.0 * x * z + (3.0 if i % 4 == 0 else 0.0)
        data.append((None if i % 4 == 0 else x, z, y))
    df = spark.createDataFrame(data, "x double, z double, gas_demand double")
    m = md.fit_gas_model(df, ["x", "z"], monotone=False, rounds=40, max_depth=4, min_rows=2)
    pred = md.predict(m, df, ["x", "z"])
    assert pred.columns == ["x", "z", "gas_demand", "prediction"]
    assert pred.where("x is null").count() == 100  # scoring leaves the inputs as they are
    r2 = me.regression_metrics(pred, "gas_demand", "prediction", keys=[]).first().r2
    assert r2 > 0.9
    assert abs(sum(v for _, v in md.importances(m, ["x", "z"])) - 1) < 1e-9


def test_r2_keeps_its_digits_far_from_zero(spark):
    rnd = np.random.default_rng(6)
    y = 1e9 + np.linspace(0, 10, 100)
    p = y + rnd.normal(0, 0.01, 100)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    want = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    got = me.regression_metrics(df, "y", "p", keys=[]).first()
    assert abs(got.r2 - want) < 1e-6 and got.r2 > 0.999


def test_changed_rows_with_null_keys(spark):
    schema = "a string, b string, v double"
    old = spark.createDataFrame([(None, "x", 1.0), ("k", None, 2.0), ("k", "y", 3.0)], schema)
    new = spark.createDataFrame([(None, "x", 1.5), ("k", None, 2.0), (None, None, 9.0)], schema)
    d = {(r.a, r.b): (r.kind, r.v) for r in ch.changed_rows(new, old, ["a", "b"]).collect()}
    assert d == {(None, "x"): ("update", 1.5), ("k", None): ("same", 2.0),
                 ("k", "y"): ("delete", 3.0), (None, None): ("insert", 9.0)}
    key = ["a", "b"]
    want = sorted(map(str, new.collect()))
    assert sorted(map(str, ch.merge(old, new, key).collect())) == want
    assert sorted(map(str, ch.upsert(old, ch.changed_rows(new, old, key), key).collect())) == want


def test_changed_rows_rejects_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (1, "c")], "k long, v string")
    with pytest.raises(Exception, match="repeated key"):
        ch.changed_rows(new, old, ["k"]).collect()


def test_merge_keeps_base_columns_the_edits_lack(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, v string, extra int")
    new = spark.createDataFrame([(1, "z"), (3, "n")], "k long, v string")
    got = sorted(map(tuple, ch.merge(old, new, ["k"]).collect()))
    assert got == [(1, "z", 10), (3, "n", None)]


def test_tune_forest_scores_every_draw_on_time_folds(spark):
    rnd = np.random.default_rng(3)
    start = dt.date(2024, 1, 1)
    data = [("s", start + dt.timedelta(days=i), float(a), float(3 * a + rnd.normal()))
            for i, a in enumerate(rnd.uniform(0, 10, 120))]
    df = spark.createDataFrame(data, "series_id string, date date, a double, max_demand double")
    res = md.tune_forest(df, ["a"], n_draws=2, parallelism=4, refit=False)
    assert [t["draw"] for t in res.trials] == [0, 1]
    assert all(np.isfinite(t["mean_mae"]) and t["mean_mae"] < 5 for t in res.trials)
    best = min(res.trials, key=lambda t: (t["mean_mae"], t["draw"]))
    assert res.best_params == {k: best[k] for k in md.FOREST_GRID}


@pytest.mark.parametrize("n", [500, 20000])
def test_nodes_of_a_tree_stay_within_their_bound(spark, n):
    df = spark.range(n).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("max_demand"))
    m = md.fit_demand_forest(df, ["a", "b"], num_trees=4, sub_forests=2, max_nodes=63)
    counts = [t.numNodes for f in m.forests for t in f.trees]
    assert len(counts) == 4 and 31 < max(counts) <= 63


def test_depth_within_a_number_of_nodes():
    assert [md.depth_within(None, n) for n in (3, 6, 7, 62, 63, 16383)] == [1, 1, 2, 4, 5, 13]
    assert md.depth_within(None, None) is None and md.depth_within(4, 16383) == 4 and md.depth_within(20, 63) == 5
