"""Registered queries for ingest, change sets and upserts.

The edited table is derived from ``orders`` by fixed rules: keys with
``k % 97 < 3`` get +1.00 on the price (runs of three consecutive keys),
``k % 389 = 5`` get priority ``1-URGENT``, ``k % 101 = 7`` are deleted and
rows with ``k % 113 = 0`` are copied under the new key ``-k - 1``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loadcast import schema as S
from loadcast.catalog import sqlparts as Q
from loadcast.catalog.common import demand
from loadcast.operators import changes as ch
from loadcast.operators import incremental as inc
from loadcast.sources import ingest as io
from loadcast.sources.panels import read_table
from loadcast.session import scratch_path

KEY = ["o_orderkey"]
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority"]
COMPARE = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def base_orders(spark, sf):
    return read_table(spark, sf, "orders").select(*ORDER_COLS)


def edited_orders(spark, sf):
    o = base_orders(spark, sf)
    k = F.col("o_orderkey")
    kept = (o.where(~(k % 101 == 7))
            .withColumn("o_totalprice", F.when(k % 97 < 3, F.col("o_totalprice") + 1.0)
                        .otherwise(F.col("o_totalprice")))
            .withColumn("o_orderpriority", F.when(k % 389 == 5, F.lit("1-URGENT"))
                        .otherwise(F.col("o_orderpriority"))))
    added = o.where(k % 113 == 0).withColumn("o_orderkey", -k - 1)
    return kept.unionByName(added)


EDIT_SQL = """
WITH base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders),
edited AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 97 < 3 THEN o_totalprice + 1.0 ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 389 = 5 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
  FROM base WHERE NOT (o_orderkey % 101 = 7)
  UNION ALL
  SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM base WHERE o_orderkey % 113 = 0
),
diff AS (
  SELECT COALESCE(n.o_orderkey, o.o_orderkey) AS o_orderkey,
    CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete'
         WHEN n.o_custkey IS DISTINCT FROM o.o_custkey OR n.o_orderstatus IS DISTINCT FROM o.o_orderstatus
           OR n.o_totalprice IS DISTINCT FROM o.o_totalprice OR n.o_orderdate IS DISTINCT FROM o.o_orderdate
           OR n.o_orderpriority IS DISTINCT FROM o.o_orderpriority THEN 'update' ELSE 'same' END AS kind,
    CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice,
    CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderpriority ELSE o.o_orderpriority END AS o_orderpriority,
    CASE WHEN n.o_orderkey IS NOT NULL AND o.o_orderkey IS NOT NULL THEN concat_ws(',',
      CASE WHEN n.o_custkey IS DISTINCT FROM o.o_custkey THEN 'o_custkey' END,
      CASE WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN 'o_orderstatus' END,
      CASE WHEN n.o_totalprice IS DISTINCT FROM o.o_totalprice THEN 'o_totalprice' END,
      CASE WHEN n.o_orderdate IS DISTINCT FROM o.o_orderdate THEN 'o_orderdate' END,
      CASE WHEN n.o_orderpriority IS DISTINCT FROM o.o_orderpriority THEN 'o_orderpriority' END)
    ELSE '' END AS changed_cols
  FROM edited n FULL OUTER JOIN base o ON n.o_orderkey = o.o_orderkey
)
"""


def _diff(spark, sf):
    return ch.changed_rows(edited_orders(spark, sf), base_orders(spark, sf), KEY, COMPARE)


def a6_changed_rows(spark, sf):
    d = _diff(spark, sf)
    return d.select(*KEY, "kind", "o_totalprice", "o_orderpriority",
                    F.array_join("changed", ",").alias("changed_cols"))


A6_SQL = EDIT_SQL + "SELECT o_orderkey, kind, o_totalprice, o_orderpriority, changed_cols FROM diff\n"


def a6_changed_by_digest(spark, sf):
    """The same from digests kept beside the base table: only key buckets that differ are compared."""
    path = inc.write_with_digests(base_orders(spark, sf), scratch_path(spark, "orders_digests"), KEY, COMPARE, buckets=64, coarse=8)
    d = inc.changed_by_digest(edited_orders(spark, sf), path, KEY, COMPARE, buckets=64, coarse=8)
    return d.select(*KEY, "kind", "o_totalprice", "o_orderpriority",
                    F.array_join("changed", ",").alias("changed_cols"))


def a7_changed_columns(spark, sf):
    return ch.changed_columns(_diff(spark, sf))


A7_SQL = EDIT_SQL + """
SELECT column_name, COUNT(*) AS n_changed FROM (
  SELECT UNNEST(string_split(changed_cols, ',')) AS column_name FROM diff WHERE kind = 'update')
GROUP BY 1
"""


def a8_group_consecutive(spark, sf):
    """Changed-key ranges."""
    upd = _diff(spark, sf).where(F.col("kind") == ch.UPDATE).select(*KEY)
    return ch.group_consecutive(upd, "o_orderkey")


A8_SQL = EDIT_SQL + """
SELECT MIN(o_orderkey) AS range_start, MAX(o_orderkey) AS range_end, COUNT(*) AS n_rows FROM (
  SELECT o_orderkey, o_orderkey - ROW_NUMBER() OVER (ORDER BY o_orderkey) AS g
  FROM diff WHERE kind = 'update')
GROUP BY g
"""


def a9_upsert(spark, sf):
    """Merging the edits into the base reproduces the edited table."""
    return ch.merge(base_orders(spark, sf), edited_orders(spark, sf), KEY, COMPARE)


def a9_upsert_changes(spark, sf):
    """The same through a change set: one full outer join of base and changes."""
    changes = _diff(spark, sf).select(*KEY, "kind", *COMPARE)
    return ch.upsert(base_orders(spark, sf), changes, KEY)


A9_SQL = EDIT_SQL + "SELECT * FROM edited\n"


def a9_write_changed(spark, sf):
    """Edits of 1995 saved to a table by month: its rows after that, and whether the month's files are new ones."""
    period = F.date_format("o_orderdate", "yyyy-MM").alias("period")
    base = base_orders(spark, sf).withColumn("period", period)
    path = inc.write_by_period(base, scratch_path(spark, "orders_by_month"), "period")

    def files():
        named = spark.read.parquet(path).select("period", F.input_file_name().alias("file"))
        return named.groupBy("period").agg(F.sort_array(F.collect_set("file")).alias("files"))

    before = spark.createDataFrame(files().collect(), files().schema)  # some files a month
    edited = edited_orders(spark, sf).withColumn("period", period)
    within = F.year("o_orderdate") == 1995
    changes = ch.changed_rows(edited.where(within), base.where(within), KEY, [*COMPARE, "period"])
    inc.write_changes(path, changes, KEY, "period", "period")
    after = files().withColumnRenamed("files", "now").join(before, "period", "left")
    marks = after.select("period", (~F.col("files").eqNullSafe(F.col("now"))).alias("rewritten"))
    return spark.read.parquet(path).join(F.broadcast(marks), "period").select(*ORDER_COLS, "period", "rewritten")


A9_WRITE_SQL = EDIT_SQL + """, table_now AS (
  SELECT * FROM edited WHERE year(o_orderdate) = 1995
  UNION ALL SELECT * FROM base WHERE year(o_orderdate) <> 1995)
SELECT *, strftime(o_orderdate, '%Y-%m') AS period, year(o_orderdate) = 1995 AS rewritten FROM table_now
"""


def a5_drop_internal(spark, sf):
    df = demand(spark, sf).withColumn("month", F.month(S.DATE))
    return ch.drop_internal(df)


A5_SQL = Q.DEMAND + """
SELECT series_id, date, max_demand, solar_max, gas_demand, temp_high, temp_low, feels_like, temp_avg
FROM panel
"""


# --- ingest -------------------------------------------------------------------------

def raw_sheet(spark, sf):
    """The dense panel as a loosely typed sheet: text cells with known defects."""
    p = demand(spark, sf)
    dom = F.dayofmonth(S.DATE)
    s = F.col(S.MAX_DEMAND).cast("decimal(15,2)").cast("string")
    raw = (F.when(dom == 3, F.concat(s, F.lit("d")))
           .when(dom == 4, F.lit(""))
           .when(dom == 6, F.lit("NaN"))
           .when(dom == 8, F.regexp_replace(s, r"^(\d)", "$1,"))
           .when(dom == 14, F.concat(F.lit("  "), s, F.lit(" ")))
           .when(dom == 15, F.lit("abc"))
           .when(dom == 16, F.lit("+1.5e3"))
           .when(dom == 18, F.lit(".5"))
           .otherwise(s))
    fmt = (F.when(dom == 13, F.concat(F.year(S.DATE).cast("string"), F.lit("-13-01")))
           .when(dom == 27, F.lit(None).cast("string"))
           .when(dom == 7, F.date_format(S.DATE, "yyyy-MM-dd HH:mm:ss"))
           .when(dom == 9, F.date_format(S.DATE, "yyyy-M-d"))
           .when(dom == 11, F.date_format(S.DATE, "yyyy-MM-dd'T'00:00:00.000"))
           .when(dom == 19, F.date_format(S.DATE, "yyyy-MM-dd 23:59:59.123456"))
           .when(dom == 20, F.date_format(S.DATE, "yyyy-MM-dd'T'00:00:00'Z'"))
           .when(dom == 21, F.date_format(S.DATE, "yyyy-MM-dd 12:30"))
           .when(dom % 5 == 0, F.date_format(S.DATE, "yyyy/MM/dd"))
           .when(dom % 5 == 1, F.date_format(S.DATE, "yyyy-MM-dd'T'00:00:00"))
           .when(dom % 5 == 2, F.date_format(S.DATE, "yyyyMMdd"))
           .when(dom % 5 == 3, F.date_format(S.DATE, "yyyy.MM.dd"))
           .otherwise(F.date_format(S.DATE, "yyyy-MM-dd")))
    return p.select(S.SERIES, F.col(S.DATE).alias("true_date"), fmt.alias("date_text"),
                    raw.alias("demand_text"),
                    F.col(S.TEMP_HIGH).cast("string").alias(S.TEMP_HIGH),
                    F.col(S.TEMP_LOW).cast("string").alias(S.TEMP_LOW))


RAW_SQL = Q.DEMAND + r""", raw AS (
  SELECT series_id, date AS true_date,
    CASE WHEN day(date) = 13 THEN CAST(year(date) AS VARCHAR) || '-13-01'
         WHEN day(date) = 27 THEN NULL
         WHEN day(date) = 7 THEN strftime(date, '%Y-%m-%d 00:00:00')
         WHEN day(date) = 9 THEN strftime(date, '%Y-%-m-%-d')
         WHEN day(date) = 11 THEN strftime(date, '%Y-%m-%dT00:00:00.000')
         WHEN day(date) = 19 THEN strftime(date, '%Y-%m-%d 23:59:59.123456')
         WHEN day(date) = 20 THEN strftime(date, '%Y-%m-%dT00:00:00Z')
         WHEN day(date) = 21 THEN strftime(date, '%Y-%m-%d 12:30')
         WHEN day(date) % 5 = 0 THEN strftime(date, '%Y/%m/%d')
         WHEN day(date) % 5 = 1 THEN strftime(date, '%Y-%m-%dT00:00:00')
         WHEN day(date) % 5 = 2 THEN strftime(date, '%Y%m%d')
         WHEN day(date) % 5 = 3 THEN strftime(date, '%Y.%m.%d')
         ELSE strftime(date, '%Y-%m-%d') END AS date_text,
    CASE WHEN day(date) = 3 THEN s || 'd' WHEN day(date) = 4 THEN '' WHEN day(date) = 6 THEN 'NaN'
         WHEN day(date) = 8 THEN regexp_replace(s, '^(\d)', '\1,')
         WHEN day(date) = 14 THEN '  ' || s || ' ' WHEN day(date) = 15 THEN 'abc'
         WHEN day(date) = 16 THEN '+1.5e3' WHEN day(date) = 18 THEN '.5' ELSE s END AS demand_text,
    temp_high, temp_low
  FROM (SELECT *, CAST(CAST(max_demand AS DECIMAL(15,2)) AS VARCHAR) AS s FROM panel)
)
"""

NUM_SQL = r"""CASE WHEN regexp_full_match({x}, '\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*')
                 THEN TRY_CAST(trim({x}) AS DOUBLE) END"""
# A date, with an optional time of day after a blank or T, cut to the day.
DATE_SQL = r"""CASE
  WHEN regexp_full_match(trim({x}), '\d{{8}}') THEN TRY_CAST(try_strptime(trim({x}), '%Y%m%d') AS DATE)
  WHEN regexp_full_match(trim({x}), '\d{{4}}([-/.])\d{{1,2}}([-/.])\d{{1,2}}([T ]\d{{1,2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(Z|[+-]\d{{2}}:?\d{{2}})?)?')
  THEN TRY_CAST(regexp_replace(regexp_extract(trim({x}), '^[-0-9/.]+'), '[/.]', '-', 'g') AS DATE) END"""


def a2_coerce_numeric(spark, sf):
    df = raw_sheet(spark, sf).withColumn(S.MAX_DEMAND, F.col("demand_text"))
    out = io.coerce_numeric(df, [S.MAX_DEMAND, S.TEMP_HIGH, "no_such_column"])
    return out.select(S.SERIES, "true_date", "demand_text", S.MAX_DEMAND, S.TEMP_HIGH)


A2_SQL = RAW_SQL + f"""
SELECT series_id, true_date, demand_text, {NUM_SQL.format(x='demand_text')} AS max_demand,
       temp_high FROM raw
"""


def a3_coerce_date(spark, sf):
    df = raw_sheet(spark, sf).withColumn(S.DATE, F.col("date_text"))
    return io.coerce_date(df, S.DATE).select(S.SERIES, "true_date", "date_text", S.DATE)


A3_SQL = RAW_SQL + f"""
SELECT series_id, true_date, date_text, {DATE_SQL.format(x='date_text')} AS date FROM raw
"""


def a4_profile_range(spark, sf):
    """Row / column counts and date range before and after cleaning."""
    from loadcast.operators import profile as pr
    raw = raw_sheet(spark, sf).select(S.SERIES, F.col("date_text").alias(S.DATE),
                                      F.col("demand_text").alias(S.MAX_DEMAND), S.TEMP_HIGH)
    clean = io.coerce_numeric(io.coerce_date(raw, S.DATE), [S.MAX_DEMAND, S.TEMP_HIGH])
    clean = clean.na.drop(subset=[S.DATE, S.MAX_DEMAND])
    before = pr.profile_range(io.coerce_date(raw, S.DATE)).withColumn("stage", F.lit("raw"))
    after = pr.profile_range(clean).withColumn("stage", F.lit("clean"))
    return before.unionByName(after)


A4_SQL = RAW_SQL + f"""
, c AS (SELECT series_id, {DATE_SQL.format(x='date_text')} AS date,
               {NUM_SQL.format(x='demand_text')} AS max_demand, temp_high FROM raw)
SELECT COUNT(*) AS n_rows, 4 AS n_columns, MIN(date) AS min_date, MAX(date) AS max_date, 'raw' AS stage FROM c
UNION ALL
SELECT COUNT(*), 4, MIN(date), MAX(date), 'clean' FROM c WHERE date IS NOT NULL AND max_demand IS NOT NULL
"""


def a1_read_table(spark, sf):
    """Write the sheet as CSV (A13), read it back as all-text (A1), coerce (A2, A3)."""
    sheet = raw_sheet(spark, sf).select(S.SERIES, F.col("date_text").alias(S.DATE),
                                        F.col("demand_text").alias(S.MAX_DEMAND),
                                        S.TEMP_HIGH, S.TEMP_LOW)
    path = io.write_csv(sheet, scratch_path(spark, "sheet"))
    back = io.read_table(spark, path)
    back = io.coerce_numeric(io.coerce_date(back, S.DATE), [S.MAX_DEMAND, S.TEMP_HIGH, S.TEMP_LOW])
    return back


A1_SQL = RAW_SQL + f"""
SELECT series_id, {DATE_SQL.format(x='date_text')} AS date, {NUM_SQL.format(x='demand_text')} AS max_demand,
       temp_high, temp_low
FROM raw
"""


def _rendered_orders(spark, sf):
    o = base_orders(spark, sf)
    k = F.col("o_orderkey")
    return o.withColumns({
        "o_orderpriority": F.when(k % 50 != 0, F.col("o_orderpriority")),
        "iso_text": F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.lit("Tuesday text")),
    })


RENDER_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
       CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority ELSE '' END AS o_orderpriority,
       CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'Tuesday text' END AS iso_text
FROM orders
"""


def a12_render_cell(spark, sf):
    return io.render_table(_rendered_orders(spark, sf))


def a10_replace_table(spark, sf):
    """Render and overwrite the whole table as CSV, then read it back as text."""
    path = io.replace_table(_rendered_orders(spark, sf), scratch_path(spark, "replace"))
    back = spark.read.option("header", True).option("inferSchema", False) \
        .option("nullValue", None).csv(path)
    return back.na.fill("")


def a11_normalize_date_strings(spark, sf):
    raw = raw_sheet(spark, sf)
    out = io.normalize_date_strings(raw, ["date_text", "no_such_column"])
    return out.select(S.SERIES, "true_date", F.col("date_text").alias("date_norm"))


A11_SQL = RAW_SQL + f"""
SELECT series_id, true_date, strftime({DATE_SQL.format(x='date_text')}, '%Y-%m-%d') AS date_norm FROM raw
"""


def a13_write_csv(spark, sf):
    """Typed orders written as CSV with a header and read back as text (rows check)."""
    path = io.write_csv(base_orders(spark, sf), scratch_path(spark, "orders_csv"))
    return io.read_table(spark, path)


# Spark's CSV text of the typed columns: numbers in their shortest form,
# timestamps as yyyy-MM-ddTHH:mm:ss.SSS.
A13_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS o_orderdate, o_orderpriority
FROM orders
"""


def a13_round_trip(spark, sf):
    """Typed orders written as CSV and as Parquet, read back (A1) and coerced (A2, A3)."""
    out = None
    for fmt in ("csv", "parquet"):
        path = scratch_path(spark, f"orders_{fmt}")
        if fmt == "csv":
            io.write_csv(base_orders(spark, sf), path)
        else:
            base_orders(spark, sf).write.parquet(path)
        back = io.coerce_date(io.read_table(spark, path, fmt), "o_orderdate")
        back = io.coerce_numeric(back, ["o_totalprice"]).select(
            F.col("o_orderkey").cast("long"), "o_orderdate", "o_totalprice", "o_orderpriority",
            F.lit(fmt).alias("fmt"))
        out = back if out is None else out.unionByName(back)
    return out


A13_TRIP_SQL = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice, o_orderpriority, f.fmt AS fmt
FROM orders, (SELECT unnest(['csv', 'parquet']) AS fmt) f
"""


def a1_bad_records(spark, sf):
    """Orders as text with lines cut short (keys ``% 101 = 7``) or one cell too long (``% 89 = 3``):
    every quarantined line, and the good rows by status."""
    k = F.col("o_orderkey")
    cells = [k.cast("string"), F.col("o_orderstatus"), F.when(k % 101 != 7, F.col("o_orderpriority")),
             F.when(k % 89 == 3, F.lit("extra"))]
    path, quarantine = scratch_path(spark, "lines"), scratch_path(spark, "quarantine")
    header = "o_orderkey,o_orderstatus,o_orderpriority"
    lines = base_orders(spark, sf).select(F.concat_ws(",", *cells).alias(header))
    lines.write.option("header", True).option("sep", "\u0001").csv(path)
    good = io.read_with_quarantine(spark, path, quarantine)
    bad = spark.read.parquet(quarantine)
    return (bad.groupBy(F.lit("bad").alias("kind"), "line").agg(F.count(F.lit(1)).alias("n"))
            .unionByName(good.groupBy(F.lit("good").alias("kind"), F.col("o_orderstatus").alias("line"))
                         .agg(F.count("o_orderpriority").alias("n"))))


A1_BAD_SQL = """
WITH l AS (SELECT o_orderkey AS k, o_orderstatus AS s,
                  CASE WHEN o_orderkey % 101 <> 7 THEN o_orderpriority END AS p,
                  CASE WHEN o_orderkey % 89 = 3 THEN 'extra' END AS x FROM orders),
m AS (SELECT *, (p IS NULL) <> (x IS NOT NULL) AS bad FROM l)
SELECT 'bad' AS kind, concat_ws(',', CAST(k AS VARCHAR), s, p, x) AS line, COUNT(*) AS n FROM m WHERE bad GROUP BY 2
UNION ALL
SELECT 'good', s, COUNT(*) FROM m WHERE NOT bad GROUP BY 2
"""


QUERIES = {
    "a1_bad_records": (a1_bad_records, A1_BAD_SQL),
    "a1_read_table": (a1_read_table, A1_SQL),
    "a2_coerce_numeric": (a2_coerce_numeric, A2_SQL),
    "a3_coerce_date": (a3_coerce_date, A3_SQL),
    "a4_profile_range": (a4_profile_range, A4_SQL),
    "a5_drop_internal": (a5_drop_internal, A5_SQL),
    "a6_changed_rows": (a6_changed_rows, A6_SQL),
    "a6_changed_by_digest": (a6_changed_by_digest, A6_SQL),
    "a7_changed_columns": (a7_changed_columns, A7_SQL),
    "a8_group_consecutive": (a8_group_consecutive, A8_SQL),
    "a9_upsert": (a9_upsert, A9_SQL),
    "a9_upsert_changes": (a9_upsert_changes, A9_SQL),
    "a9_write_changed": (a9_write_changed, A9_WRITE_SQL),
    "a10_replace_table": (a10_replace_table, RENDER_SQL),
    "a11_normalize_date_strings": (a11_normalize_date_strings, A11_SQL),
    "a12_render_cell": (a12_render_cell, RENDER_SQL),
    "a13_write_csv": (a13_write_csv, A13_SQL),
    "a13_round_trip": (a13_round_trip, A13_TRIP_SQL),
}
