"""Steps that need nothing of each other run at once: fits, and the files of sub-forests."""

from threading import Barrier

from pyspark.sql import functions as F

from loadcast.catalog import model_queries as mq
from loadcast.catalog import state_queries as sq
from loadcast.plans import models as md
from loadcast.plans import scoring


class Meeting:
    """A sub-forest that is saved only while another one is."""

    def __init__(self, both, saved):
        self.both, self.saved = both, saved

    def write(self):
        return self

    def session(self, spark):
        return self

    def overwrite(self):
        return self

    def save(self, path):
        self.both.wait(timeout=10)
        self.saved.append(path)


def test_sub_forests_are_saved_side_by_side(spark, tmp_path):
    both, saved = Barrier(2), []
    md.ForestEnsemble(["a"], [Meeting(both, saved) for _ in range(4)]).save(str(tmp_path))
    assert sorted(saved) == [f"{tmp_path}/forest_{i}" for i in range(4)]
    assert spark.read.text(f"{tmp_path}/meta").first()[0]


def test_loaded_sub_forests_keep_their_order(spark, tmp_path):
    df = spark.range(400).select(F.col("id").cast("double").alias("a"), (F.col("id") % 37).cast("double").alias("y"))
    m = md.fit_demand_forest(df, ["a"], label="y", num_trees=14, sub_forests=6, max_depth=4)
    m.save(str(tmp_path / "forest"))
    back = md.ForestEnsemble.load(spark, str(tmp_path / "forest"))
    assert back.weights == m.weights == [3, 3, 2, 2, 2, 2]
    assert [f.toDebugString.split("\n", 1)[1] for f in back.forests] == \
        [f.toDebugString.split("\n", 1)[1] for f in m.forests]


def test_kept_models_are_fitted_side_by_side(spark, monkeypatch):
    both, kept = Barrier(2), []

    def fit(name):
        def one(spark, sf):
            both.wait(timeout=10)
            return name
        return one

    monkeypatch.setattr(sq, "_CACHE", {})
    monkeypatch.setattr(mq, "panel", lambda spark, sf: "panel")
    monkeypatch.setattr(mq, "trained_demand", fit("demand"))
    monkeypatch.setattr(mq, "trained_trees", fit("gas"))
    monkeypatch.setattr(scoring, "save_models", lambda path, demand, gas: kept.append((path, demand, gas)))
    monkeypatch.setattr(scoring, "save_state", lambda hist, path: kept.append((path, hist)))
    path = sq._kept(spark, "sf")
    assert kept == [(path, "panel"), (path, "demand", "gas")]
