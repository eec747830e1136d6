"""Profiling: range summary, describe, value counts, null counts.

``describe`` needs exact quartiles. Spark's ``percentile`` aggregate merges
every distinct value of a column into one task, which does not survive a
column of billions of values. Here equal values are counted first (with
map-side aggregation, so a value that half of the rows share costs one row
per task), and a distributed running total of these counts by (column_name,
value) tells which value holds each wanted rank (at most 2 per column and
quantile).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcast import schema as S
from loadcast.operators.ranking import running_totals

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def profile_range(df: DataFrame, date_col: str = S.DATE) -> DataFrame:
    """A4: row count, column count, first and last date (one row)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_columns"),
                  F.min(date_col).alias("min_date"),
                  F.max(date_col).alias("max_date"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def unpivot(df: DataFrame, cols: list[str], cast: str = "double") -> DataFrame:
    """Long form ``(column_name, value)`` of the listed columns."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast(cast).alias("value"))
        for c in cols])).alias("_kv")).select("_kv.column_name", "_kv.value")


def exact_quantiles(long: DataFrame, probs: list[float],
                    num_partitions: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per ``column``.

    Returns ``(column_name, q, value)``. Nulls and NaN are ignored.
    """
    vals = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = vals.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_c"))
    upto = running_totals(counted, ["column_name", "value"], "_c", num_partitions, out="_upto")
    # One row per column: bounded by the column count.
    counts = upto.groupBy("column_name").agg(F.sum("_c").alias("_n"), F.max("_upto").alias("_end"))
    qs = F.array(*[F.lit(float(p)) for p in probs])
    need = (counts.withColumn("q", F.explode(qs))
            .withColumn("_pos", F.col("q") * (F.col("_n") - 1))
            .withColumn("_lo", F.floor("_pos"))
            .withColumn("_hi", F.ceil("_pos"))
            .withColumn("_frac", F.col("_pos") - F.col("_lo")))
    start = F.col("_end") - F.col("_n")
    picks = need.select("column_name", "q", "_frac", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), (start + F.col("_lo")).alias("_rank")),
        F.struct(F.lit(1).alias("side"), (start + F.col("_hi")).alias("_rank")),
    )).alias("_s")).select("column_name", "q", "_frac", "_s.side", "_s._rank")
    # At most two rows per column and quantile.
    got = upto.join(F.broadcast(picks), "column_name").where(
        (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    return got.groupBy("column_name", "q").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("_a"),
        F.max(F.when(F.col("side") == 1, F.col("value"))).alias("_b"),
        F.first("_frac").alias("_f"),
    ).select("column_name", "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("value"))


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D3: count, mean, std (sample), min, 25/50/75 %, max per numeric column."""
    cols = cols or numeric_columns(df)
    long = unpivot(df, cols)
    ok = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = ok.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = exact_quantiles(long, [0.25, 0.5, 0.75])
    piv = q.groupBy("column_name").agg(*[
        F.max(F.when(F.col("q") == p, F.col("value"))).alias(name)
        for p, name in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")]])
    return stats.join(piv, "column_name", "left")


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column_name, value, count)`` of non-null values, most frequent first."""
    cols = cols or string_columns(df)
    long = unpivot(df, cols, cast="string").where(F.col("value").isNotNull())
    return (long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("column_name", F.col("count").desc(), "value"))


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, n_null)`` for columns with at least one null (one pass)."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    long = sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns
    ])).alias("_kv")).select("_kv.column_name", "_kv.n_null")
    return long.where(F.col("n_null") > 0)
