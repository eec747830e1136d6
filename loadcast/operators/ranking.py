"""Row positions and running totals without a single-partition window.

``row_number()`` over ``partitionBy(g)`` puts a whole group in one task; a
group holding a third of all rows then becomes one enormous task. Here rows
are range-partitioned on ``(group, order)`` (a hot group is cut across many
tasks) and sorted inside each partition, and each row's global position is
its partition's offset plus its index in the partition.

The sorted frame is written once to the shared scratch folder. Offsets and
rows are both read from there: planned twice, each side would sample range
bounds of its own and the offsets could belong to another layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.session import scratch_path


def _ranged(df: DataFrame, order: list[str | Column], num_partitions: int | None) -> DataFrame:
    """``df`` sorted by ranges, with ``_pid`` and the ascending ``_mid``, as a written table.

    Rows with equal order values are told apart by a hash of the whole row,
    so that a value which very many rows share can be cut by the ranges.
    """
    spark = df.sparkSession
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = [F.col(c) for c in df.columns
             if df.schema[c].dataType.typeName() not in ("map", "variant")]
    full = [*order, F.xxhash64(*plain)]
    path = scratch_path(spark, "ranged")
    (df.repartitionByRange(parts, *full).sortWithinPartitions(*full)
     .withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
     .write.parquet(path))
    return spark.read.parquet(path)


def _before_partition(per_part: DataFrame, value: str) -> DataFrame:
    """Per ``_pid`` the sum of ``value`` over the partitions before it (one row per partition)."""
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.withColumn("_off", F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def global_positions(df: DataFrame, order: list[str | Column],
                     num_partitions: int | None = None, out: str = "_gpos") -> DataFrame:
    """Adds ``out``: the 0-based position of each row in the total order ``order``.

    Rows with equal order values get different positions, in the order of a
    hash of the whole row, so the result is the same when a task is recomputed.
    """
    srt = _ranged(df, order, num_partitions)
    per_part = srt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    offs = _before_partition(per_part, "_c").select("_pid", "_off", "_m0")
    return (srt.join(F.broadcast(offs), "_pid")  # one row per partition
            .withColumn(out, F.col("_off") + F.col("_mid") - F.col("_m0"))
            .drop("_pid", "_mid", "_off", "_m0"))


def running_totals(df: DataFrame, order: list[str], weight: str,
                   num_partitions: int | None = None, out: str = "_upto") -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over all rows up to and including each one."""
    srt = _ranged(df, order, num_partitions)
    per_part = srt.groupBy("_pid").agg(F.sum(weight).alias("_c"))
    offs = _before_partition(per_part, "_c").select("_pid", "_off")
    inside = (Window.partitionBy("_pid").orderBy("_mid")
              .rowsBetween(Window.unboundedPreceding, 0))
    return (srt.join(F.broadcast(offs), "_pid")  # one row per partition
            .withColumn(out, F.col("_off") + F.sum(weight).over(inside))
            .drop("_pid", "_mid", "_off"))


def group_row_numbers(df: DataFrame, group: list[str], order: list[str],
                      out: str = "row_number", size: str | None = None) -> DataFrame:
    """``row_number()`` (1-based) within ``group`` by ``order``, plus the group
    size in ``size`` if given, computed with :func:`global_positions`."""
    pos = global_positions(df, [*group, *order])
    if not group:
        res = pos.withColumn(out, F.col("_gpos") + 1)
        if size:
            res = res.withColumn(size, F.lit(res.count()))
        return res.drop("_gpos")
    starts = pos.groupBy(*group).agg(F.min("_gpos").alias("_gs"),
                                     F.count(F.lit(1)).alias("_gn"))
    same = None
    for g in group:
        starts = starts.withColumnRenamed(g, f"_g_{g}")
        c = F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        same = c if same is None else same & c
    res = pos.join(starts, same).withColumn(out, F.col("_gpos") - F.col("_gs") + 1)
    if size:
        res = res.withColumn(size, F.col("_gn"))
    return res.drop("_gpos", "_gs", "_gn", *[f"_g_{g}" for g in group])
