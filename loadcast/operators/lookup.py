"""Lookups against history: as-of, same weekday last week, last-year week, tails.

History is a daily panel (one row per series and date). Targets are rows of
``(series_id, date)``. Lookups that need "the latest value before t" are
written as a union of targets and history plus one window over the shared
series partitioning (one shuffle, no row explosion) instead of a ``<`` join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.functions import calendar as cal


def observed_on(targets: DataFrame, history: DataFrame, cols: list[str],
                keys: list[str] | None = None, tiebreak: str | None = None) -> DataFrame:
    """Values of ``cols`` observed on the target date (first match), else null.

    History is reduced to one row per (series, date) first: the one with the
    smallest ``tiebreak`` (nulls last), or without one the smallest values.
    """
    keys = keys or [S.SERIES]
    order = [tiebreak] if tiebreak else cols
    first = F.min_by(F.struct(*[F.col(c).alias(f"obs_{c}") for c in cols]),
                     F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))]))
    one = history.groupBy(*keys, S.DATE).agg(first.alias("_row")).select(*keys, S.DATE, "_row.*")
    return targets.join(one, keys + [S.DATE], "left")


def last_before(targets: DataFrame, history: DataFrame, value: str,
                keys: list[str] | None = None, out: str = "last_value",
                bucket_days: int | None = None) -> DataFrame:
    """As-of lookup (strict, backward): latest non-null ``value`` dated < target.

    Targets (k = 0) and history (k = 1) are unioned and sorted by (date, k)
    within the series, so a target sorts before same-day history and only
    strictly earlier rows are in its frame. ``last(ignorenulls)`` over
    ``rowsBetween(unboundedPreceding, -1)`` then carries the latest value
    forward; the date of that value comes along in a struct.

    ``bucket_days`` switches to the two-level form for history that is not a
    daily panel (one series may hold a large share of all rows): windows run
    within (series, time bucket), and targets with no match in their own
    bucket take the last value of the nearest earlier bucket from a
    per-bucket summary (one row per series and bucket).
    """
    keys = keys or [S.SERIES]
    if bucket_days:
        return _last_before_bucketed(targets, history, value, keys, out, bucket_days)
    extra = [c for c in targets.columns if c not in keys + [S.DATE]]
    # Other target columns ride along in a struct, so no join back is needed.
    payload = F.struct(*[F.col(c) for c in extra]) if extra else F.lit(None).cast("int")
    t = targets.select(*keys, S.DATE, F.lit(0).alias("_k"),
                       F.lit(None).cast("struct<d:date,v:double>").alias("_hv"),
                       payload.alias("_tp"))
    tp_type = t.schema["_tp"].dataType.simpleString()
    h = (history.where(F.col(value).isNotNull())
         .select(*keys, S.DATE, F.lit(1).alias("_k"),
                 F.struct(F.col(S.DATE).alias("d"), F.col(value).cast("double").alias("v"))
                 .alias("_hv"),
                 F.lit(None).cast(tp_type).alias("_tp")))
    w = (Window.partitionBy(*keys).orderBy(S.DATE, "_k")
         .rowsBetween(Window.unboundedPreceding, -1))
    u = t.unionByName(h).withColumn("_m", F.last("_hv", ignorenulls=True).over(w))
    return u.where(F.col("_k") == 0).select(
        *keys, S.DATE, *[F.col(f"_tp.{c}").alias(c) for c in extra],
        F.col("_m.v").alias(out), F.col("_m.d").alias(f"{out}_date"))


def _last_before_bucketed(targets: DataFrame, history: DataFrame, value: str,
                          keys: list[str], out: str, bucket_days: int) -> DataFrame:
    bucket = F.floor(F.unix_date(F.col(S.DATE)) / F.lit(bucket_days)).cast("long")
    hist = (history.where(F.col(value).isNotNull())
            .select(*keys, S.DATE, F.col(value).cast("double").alias(value))
            .withColumn("_bk", bucket))
    # Level 1: the usual single pass, partitioned by (series, bucket).
    level1 = last_before(targets.withColumn("_bk", bucket), hist, value, keys + ["_bk"], out)
    # One row per (series, bucket): the bucket's last value and its date.
    summary = hist.groupBy(*keys, "_bk").agg(
        F.max_by(F.struct(F.col(S.DATE).alias("d"), F.col(value).alias("v")),
                 F.col(S.DATE)).alias("_last"))
    # Level 2: each target bucket takes the summary of the nearest earlier
    # bucket, an as-of over bucket numbers (bounded by the bucket count).
    tb = level1.select(*keys, "_bk").distinct()
    lk = (tb.select(*keys, "_bk", F.lit(0).alias("_k"),
                    F.lit(None).cast("struct<d:date,v:double>").alias("_s"))
          .unionByName(summary.select(*keys, "_bk", F.lit(1).alias("_k"),
                                      F.col("_last").alias("_s"))))
    wb = (Window.partitionBy(*keys).orderBy("_bk", "_k")
          .rowsBetween(Window.unboundedPreceding, -1))
    prior = (lk.withColumn("_p", F.last("_s", ignorenulls=True).over(wb))
             .where("_k = 0").select(*keys, "_bk", "_p"))
    res = level1.join(prior, keys + ["_bk"], "left")
    return res.select(
        *[c for c in level1.columns if c not in ("_bk", out, f"{out}_date")],
        F.coalesce(F.col(out), F.col("_p.v")).alias(out),
        F.when(F.col(out).isNotNull(), F.col(f"{out}_date"))
        .otherwise(F.col("_p.d")).alias(f"{out}_date"))


def _union_key(kind: str = "_k"):
    """Order key for a union of targets (k = 0) and history (k = 1): day * 2 + k,
    so a target sorts before same-day history and day offsets stay exact."""
    return F.unix_date(F.col(S.DATE)).cast("long") * 2 + F.col(kind)


def prior_ordinal(targets: DataFrame, history: DataFrame, value: str, n: int,
                  keys: list[str] | None = None, out: str = "nth_prior") -> DataFrame:
    """The n-th latest non-null ``value`` strictly before each target date.

    Each history row carries ``lag(value, n - 1)`` (the n-th latest value
    counting from itself); a target takes what the latest history row before
    it carries. One union and one window pass, no join.
    """
    keys = keys or [S.SERIES]
    hist = (history.where(F.col(value).isNotNull()).select(*keys, S.DATE, value)
            .withColumn("_carry", F.lag(value, n - 1).over(
                Window.partitionBy(*keys).orderBy(S.DATE))))
    t = targets.select(*keys, S.DATE, F.lit(0).alias("_k"),
                       F.lit(None).cast("struct<c:double>").alias("_c"))
    h = hist.select(*keys, S.DATE, F.lit(1).alias("_k"),
                    F.struct(F.col("_carry").cast("double").alias("c")).alias("_c"))
    w = (Window.partitionBy(*keys).orderBy(_union_key())
         .rowsBetween(Window.unboundedPreceding, -1))
    u = t.unionByName(h).withColumn("_m", F.last("_c", ignorenulls=True).over(w))
    return u.where("_k = 0").select(*keys, S.DATE, F.col("_m.c").alias(out))


def same_dow_last_week(targets: DataFrame, history: DataFrame,
                       keys: list[str] | None = None) -> DataFrame:
    """E5: demand on target - 7 days; else the 7th latest prior value; else 0.

    One union of targets and history and one window pass over the series:
    the exact value is a RANGE frame exactly 7 days back, the fallback is
    carried from the latest history row before the target (its
    ``lag(value, 6)``), so neither needs a join.
    """
    keys = keys or [S.SERIES]
    v = S.MAX_DEMAND
    hist = (history.where(F.col(v).isNotNull()).select(*keys, S.DATE, v)
            .withColumn("_l6", F.lag(v, 6).over(Window.partitionBy(*keys).orderBy(S.DATE))))
    t = targets.select(*keys, S.DATE, F.lit(0).alias("_k"),
                       F.lit(None).cast("double").alias("_v"),
                       F.lit(None).cast("struct<c:double>").alias("_c"))
    h = hist.select(*keys, S.DATE, F.lit(1).alias("_k"), F.col(v).cast("double").alias("_v"),
                    F.struct(F.col("_l6").cast("double").alias("c")).alias("_c"))
    w = Window.partitionBy(*keys).orderBy(_union_key())
    u = t.unionByName(h).withColumns({
        "_exact": F.max("_v").over(w.rangeBetween(-13, -13)),
        "_m": F.last("_c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })
    return u.where("_k = 0").select(
        *keys, S.DATE, F.coalesce("_exact", "_m.c", F.lit(0.0)).alias("demand_last_week"))


def same_week_last_year(targets: DataFrame, history: DataFrame,
                        keys: list[str] | None = None) -> DataFrame:
    """The Monday-based week around the same date last year, with demand.

    anchor = target - 12 months (29 Feb -> 28 Feb); the week runs from the
    Monday on or before the anchor for 7 days. Seven generated rows per target
    are left-joined to history on (series, date).
    """
    keys = keys or [S.SERIES]
    anchor = F.add_months(F.col(S.DATE), -12)
    monday = F.date_sub(anchor, F.weekday(anchor))
    week = targets.select(*keys, F.col(S.DATE).alias("target_date"),
                          F.explode(F.sequence(monday, F.date_add(monday, 6))).alias(S.DATE))
    hist = history.select(*keys, S.DATE, S.MAX_DEMAND)
    return (week.join(hist, keys + [S.DATE], "left")
            .withColumn(S.WEEKDAY_NAME, cal.weekday_name_expr(S.DATE))
            .select(*keys, "target_date", S.DATE, S.WEEKDAY_NAME, S.MAX_DEMAND))


def next_target_date(history: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The day after the latest date of each series."""
    keys = keys or [S.SERIES]
    return history.groupBy(*keys).agg(F.date_add(F.max(S.DATE), 1).alias(S.DATE))


def gas_before(targets: DataFrame, history: DataFrame,
               keys: list[str] | None = None) -> DataFrame:
    """C6 as of each target date: ``last_gas`` and ``prev_gas`` of the last two days
    strictly before it on which gas and solar both exist. No join: one union of
    targets and history and one window pass."""
    keys = keys or [S.SERIES]
    usable = history.where(F.col(S.GAS_DEMAND).isNotNull() & F.col(S.SOLAR_MAX).isNotNull())
    hist = usable.select(*keys, S.DATE, S.GAS_DEMAND).withColumn("_prev", F.lag(
        S.GAS_DEMAND, 1).over(Window.partitionBy(*keys).orderBy(S.DATE)))
    pair = F.struct(F.col(S.GAS_DEMAND).cast("double").alias("g"),
                    F.col("_prev").cast("double").alias("p"))
    t = targets.select(*keys, S.DATE).distinct().withColumns(
        {"_k": F.lit(0), "_m": F.lit(None).cast("struct<g:double,p:double>")})
    h = hist.select(*keys, S.DATE, F.lit(1).alias("_k"), pair.alias("_m"))
    w = (Window.partitionBy(*keys).orderBy(_union_key())
         .rowsBetween(Window.unboundedPreceding, -1))
    u = t.unionByName(h).withColumn("_last", F.last("_m", ignorenulls=True).over(w))
    return u.where("_k = 0").select(*keys, S.DATE, F.col("_last.g").alias("last_gas"),
                                    F.col("_last.p").alias("prev_gas"))


def tail_values(history: DataFrame, value: str = S.MAX_DEMAND, n: int = 14,
                keys: list[str] | None = None) -> DataFrame:
    """The last ``n`` non-null values per series, in long form (pos 1 = oldest).

    ``row_number() <= n`` over a descending window lets Spark insert a
    per-partition group limit before the shuffle, so at most ``n`` rows per
    series and task cross the network.
    """
    keys = keys or [S.SERIES]
    w = Window.partitionBy(*keys).orderBy(F.col(S.DATE).desc())
    top = (history.where(F.col(value).isNotNull())
           .select(*keys, S.DATE, value)
           .withColumn("_rn", F.row_number().over(w))
           .where(F.col("_rn") <= n))
    total = F.count("*").over(Window.partitionBy(*keys))
    return top.select(*keys, S.DATE, F.col(value),
                      (total - F.col("_rn") + 1).cast("int").alias("pos"))


def tail_arrays(history: DataFrame, value: str = S.MAX_DEMAND, n: int = 14,
                keys: list[str] | None = None) -> DataFrame:
    """C5 as one array per series (oldest first); bounded to ``n`` elements."""
    keys = keys or [S.SERIES]
    long = tail_values(history, value, n, keys)
    return (long.groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("_a"))
            .select(*keys, F.transform("_a", lambda x: x[value]).alias(f"{value}_tail")))


def last_two_gas(history: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Last and previous gas value over rows where gas and solar both exist."""
    keys = keys or [S.SERIES]
    w = Window.partitionBy(*keys).orderBy(F.col(S.DATE).desc())
    ranked = (history.where(F.col(S.GAS_DEMAND).isNotNull() & F.col(S.SOLAR_MAX).isNotNull())
              .select(*keys, S.DATE, S.GAS_DEMAND)
              .withColumn("_rn", F.row_number().over(w))
              .where("_rn <= 2"))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(S.GAS_DEMAND))).alias("last_gas"),
        F.max(F.when(F.col("_rn") == 2, F.col(S.GAS_DEMAND))).alias("prev_gas"))
