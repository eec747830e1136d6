"""Finding and saving only what changed of a large table.

Two halves of one flow: digests kept beside a table tell which buckets of keys
differ before any of its rows is read (A6), and a table partitioned by period
is rewritten only in the periods that a change set touches (A9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcast.operators.changes import SAME, UPDATE, changed_rows, upsert

BUCKET = "_bucket"
BUCKETS, COARSE = 1024, 32


# --- digests ------------------------------------------------------------------------

def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, key: list[str], compare: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``(_bucket, n, h1, h2)``: order-free digests of the rows of each key bucket.

    Aggregated on the map side: a task shuffles one row per bucket at most,
    whatever it has read. Nulls are hashed as such, so a value that moves from
    one column to another is seen. ``h1`` is the xor, ``h2`` the sum of two
    64-bit hashes of a row.
    """
    cols = [*key, *compare]
    nulls = [F.col(c).isNull() for c in cols]
    return (df.select(bucket_of(key, buckets).alias(BUCKET), F.xxhash64(*cols, *nulls).alias("a"),
                      F.xxhash64(F.lit(1), *nulls, *cols).alias("b"))
            .groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("h1"),
                                 F.sum(F.col("b").cast("decimal(20,0)")).alias("h2")))


def coarse_digests(fine: DataFrame, coarse: int = COARSE) -> DataFrame:
    """The digests of groups of buckets, from those of the buckets."""
    return fine.groupBy((F.col(BUCKET) % coarse).alias(BUCKET)).agg(
        F.sum("n").alias("n"), F.bit_xor("h1").alias("h1"), F.sum("h2").cast("decimal(30,0)").alias("h2"))


def write_with_digests(df: DataFrame, path: str, key: list[str], compare: list[str] | None = None,
                       buckets: int = BUCKETS, coarse: int = COARSE) -> str:
    """A table by key bucket (``rows``) with its digests of two levels beside it (``fine``, ``coarse``)."""
    compare = compare or [c for c in df.columns if c not in key]
    (df.withColumn(BUCKET, bucket_of(key, buckets)).repartition(BUCKET)
     .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/rows"))
    fine = bucket_digests(df, key, compare, buckets)
    fine.write.mode("overwrite").parquet(f"{path}/fine")
    coarse_digests(df.sparkSession.read.parquet(f"{path}/fine"), coarse).write.mode("overwrite").parquet(f"{path}/coarse")
    return path


def unequal(new: DataFrame, old: DataFrame) -> list[int]:
    """Buckets whose digests differ or that one side lacks; there are at most as many as buckets."""
    n, o = new.alias("n"), old.alias("o")
    both = n.join(o, F.col(f"n.{BUCKET}") == F.col(f"o.{BUCKET}"), "full_outer")
    differs = ~(F.col("n.n").eqNullSafe(F.col("o.n")) & F.col("n.h1").eqNullSafe(F.col("o.h1"))
                & (F.col("n.h2") == F.col("o.h2")).eqNullSafe(F.lit(True)))
    return sorted(r[0] for r in both.where(differs).select(F.coalesce(f"n.{BUCKET}", f"o.{BUCKET}")).collect())


def changed_buckets(new: DataFrame, path: str, key: list[str], compare: list[str],
                    buckets: int = BUCKETS, coarse: int = COARSE) -> list[int]:
    """Key buckets in which ``new`` differs from the table at ``path``; only its digests are read."""
    spark = new.sparkSession
    fresh = bucket_digests(new, key, compare, buckets).cache()
    try:
        groups = unequal(coarse_digests(fresh, coarse), spark.read.parquet(f"{path}/coarse"))
        if not groups:
            return []
        mine = F.col(BUCKET) % coarse
        return unequal(fresh.where(mine.isin(groups)), spark.read.parquet(f"{path}/fine").where(mine.isin(groups)))
    finally:
        fresh.unpersist()


def changed_by_digest(new: DataFrame, path: str, key: list[str], compare: list[str] | None = None,
                      buckets: int = BUCKETS, coarse: int = COARSE) -> DataFrame:
    """A6 against a table of :func:`write_with_digests`: as :func:`changed_rows`, from the changed buckets only.

    Of the stored table only partitions of buckets with a differing digest are
    read, and only their rows are shuffled; rows of ``new`` in other buckets
    are ``same`` where they stand.
    """
    old = new.sparkSession.read.parquet(f"{path}/rows")
    compare = compare or [c for c in new.columns if c not in key and c in old.columns]
    typed = new.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in [*key, *compare]])
    found = changed_buckets(typed, path, key, compare, buckets, coarse)
    mine = bucket_of(key, buckets)
    there = mine.isin(found) if found else F.lit(False)
    part = old.where(F.col(BUCKET).isin(found) if found else F.lit(False)).drop(BUCKET)
    changes = changed_rows(typed.where(there), part, key, compare)
    same = typed.where(~there).select(*key, F.lit(SAME).alias("kind"), *compare, F.array().cast("array<string>").alias("changed"))
    return changes.unionByName(same)


# --- tables by period ---------------------------------------------------------------

def write_by_period(df: DataFrame, path: str, period: str) -> str:
    df.repartition(period).write.mode("overwrite").partitionBy(period).parquet(path)
    return path


def _files(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _exists(spark: SparkSession, path: str) -> bool:
    fs, there = _files(spark, path)
    return fs.exists(there)


def _delete(spark: SparkSession, path: str) -> None:
    fs, there = _files(spark, path)
    fs.delete(there, True)


def stage_changes(path: str, changes: DataFrame, key: list[str], period: str, source: str) -> list:
    """Write the merged rows of the touched periods beside the table; returns these periods.

    ``changes`` is a change set with the table's columns, ``period`` included
    as that of the row's new values (the old ones for a delete). An update
    whose ``source`` column, from which the period follows, has changed
    touches the period it leaves, too: those keys alone are looked up.
    The list of periods is written last; without it what is staged does not count.
    """
    spark = changes.sparkSession
    base = spark.read.parquet(path)
    real = changes.where(F.col("kind") != SAME)
    touched = real.select(period)
    moved = real.where((F.col("kind") == UPDATE) & F.array_contains("changed", source)).select(*key)
    left = base.select(*key, period).join(moved, key, "left_semi").select(period)
    periods = [r[0] for r in touched.unionByName(left).distinct().collect()]  # bounded by the calendar
    pending = f"{path}_pending"
    _delete(spark, pending)
    old = base.where(F.col(period).isin([p for p in periods if p is not None]) | (F.col(period).isNull() if None in periods else F.lit(False)))
    merged = upsert(old, real, key)
    write_by_period(merged, f"{pending}/rows", period)
    spark.createDataFrame([(p,) for p in periods], base.select(period).schema).coalesce(1).write.parquet(f"{pending}/touched")
    return periods


def settle(spark: SparkSession, path: str, period: str) -> bool:
    """Put staged periods in their place; True if there were any.

    Each step can be repeated: partitions are overwritten from the staged rows,
    which go only after all are in place. A job that ends midway leaves them,
    and the next call begins again.
    """
    pending = f"{path}_pending"
    if not _exists(spark, f"{pending}/touched/_SUCCESS"):
        return False
    staged = spark.read.schema(spark.read.parquet(path).schema).parquet(f"{pending}/rows")
    (staged.repartition(period).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(period).parquet(path))
    touched = spark.read.parquet(f"{pending}/touched")
    for row in touched.join(staged.select(period).distinct(), period, "left_anti").collect():
        if row[0] is not None:
            _delete(spark, f"{path}/{period}={row[0]}")
    _delete(spark, pending)
    spark.catalog.refreshByPath(path)
    return True


def write_changes(path: str, changes: DataFrame, key: list[str], period: str, source: str) -> list:
    """A9 as a write of what changed: the periods that the change set touches, and no other file.

    Finishes first what an earlier call has staged and not put in place.
    Applying a change set twice gives the same table.
    """
    settle(changes.sparkSession, path, period)
    periods = stage_changes(path, changes, key, period, source)
    settle(changes.sparkSession, path, period)
    return periods
