"""loadcast: daily demand-forecasting data work on Spark.

Reads loosely typed daily tables, coerces and profiles them, computes change
sets and upserts, derives calendar / temperature / lag / ratio features with
DataFrame expressions and per-series windows, splits by time without leakage,
fits Spark ML models and scores batch forecasts.

Every public function takes and returns DataFrames and stays lazy; series are
keyed by ``series_id`` and every window is partitioned by it.
"""

from loadcast.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
