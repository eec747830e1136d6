"""Reading loosely typed tables, coercion, cell rendering and table writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A number is optional blanks, an optional sign, digits with an
# optional fraction (or a bare fraction), an optional exponent, optional blanks.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# A date is year, month and day (one or two digits) parted by -, / or ., with an
# optional time of day after a blank or T and an optional zone; or eight digits.
DATE_PATTERN = (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
                r"([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")


def read_table(spark: SparkSession, path: str, fmt: str = "csv",
               columns: list[str] | None = None) -> DataFrame:
    """A1: header row gives the names, every cell of a text source is read as a string.

    Columns of a typed source keep their types, so dates and numbers need no
    parsing; :func:`coerce_date` and :func:`coerce_numeric` take either.
    Raises ``ValueError`` for a source with no data row (checked with a
    one-row probe, not a count).
    """
    if fmt == "csv":
        reader = spark.read.option("header", True).option("inferSchema", False)
        if columns:
            reader = reader.schema(T.StructType([T.StructField(c, T.StringType())
                                                 for c in columns]))
        df = reader.csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    if not df.columns or not df.take(1):
        raise ValueError(f"empty source: {path}")
    return df


BAD_LINE = "_bad_line"


def read_with_bad_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1 for text tables that may hold bad lines: ``(good rows, bad lines)``.

    A line is bad if it has fewer or more cells than the header. Such a line
    loses or shifts cells without notice in :func:`read_table`; here it is no
    row but comes back as ``(file, line)`` with its whole text. Every file
    starts with the same header line, blank lines are none, cells are text; a
    quoted line break ends a line. Both tables are lazy and read the files
    once each.
    """
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, BAD_LINE]])
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    first = text.where(F.trim("line") != "").select("line").first()
    data = text.where((F.trim("line") != "") & (F.col("line") != F.lit(first[0] if first else "")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE, "columnPruning": "false"}
    cells = data.withColumn("_c", F.from_csv("line", schema.toDDL(), options))
    bad = F.col(f"_c.{BAD_LINE}").isNotNull()
    return cells.where(~bad).select(*[F.col("_c")[c].alias(c) for c in names]), cells.where(bad).select("file", "line")


def read_with_quarantine(spark: SparkSession, path: str, quarantine: str) -> DataFrame:
    """The good rows of a text table; its bad lines are written to ``quarantine`` (Parquet) first.

    The folder is overwritten, so a repeated run leaves the same lines. An
    empty one says that no line was bad.
    """
    good, bad = read_with_bad_lines(spark, path)
    bad.write.mode("overwrite").parquet(quarantine)
    return good


def to_number(c: Column) -> Column:
    """Text -> double; anything that is not a plain number (incl. NaN) -> null."""
    s = c.cast("string")
    ok = s.rlike(NUMBER_PATTERN)
    return F.when(ok, F.trim(s).try_cast("double"))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """A2: listed columns to double; absent columns are skipped."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: to_number(F.col(c)) for c in present})


def to_date_any(c: Column) -> Column:
    """Text -> date by the fixed pattern, a time of day cut off as written; else null."""
    s = F.trim(c.cast("string"))
    part = [F.regexp_extract(s, DATE_PATTERN, k) for k in (1, 2, 3)]
    dashed = F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0"))
    return (F.when(s.rlike(DATE_PATTERN), F.try_to_date(dashed, "yyyy-MM-dd"))
            .when(s.rlike(r"^\d{8}$"), F.try_to_date(s, "yyyyMMdd")))


def coerce_date(df: DataFrame, col: str = "date") -> DataFrame:
    """A3: date column parsed (timestamps truncated to the day), bad text -> null."""
    c = F.col(col)
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(col, F.to_date(c))
    if isinstance(dtype, T.DateType):
        return df
    return df.withColumn(col, to_date_any(c))


def unique_daily(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: of repeated rows the one with the most values, ties by the values themselves.

    Every window of the library takes a daily table to hold a series and date once.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    missing = sum((F.col(c).isNull().cast("int") for c in rest), F.lit(0))
    order = F.struct(missing, *[x for c in rest for x in (F.col(c).isNull(), F.col(c))])
    one = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return one.select(*keys, "_row.*").select(*df.columns)


def normalize_date_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    """Listed string columns re-parsed as dates and written ``yyyy-MM-dd``.

    The reference guesses such columns from their first value; here the
    caller names them. Unparseable text becomes null.
    """
    return df.withColumns({c: F.date_format(to_date_any(F.col(c)), "yyyy-MM-dd")
                           for c in cols if c in df.columns})


def render_cell(c: Column, dtype: T.DataType) -> Column:
    """Null -> '', dates and timestamps -> yyyy-MM-dd, ISO text with 'T' ->
    yyyy-MM-dd, anything else -> its string form."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(dtype, T.StringType):
        iso = F.to_date(F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
        out = F.when(c.contains("T") & iso.isNotNull(), F.date_format(iso, "yyyy-MM-dd")) \
            .otherwise(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def render_table(df: DataFrame) -> DataFrame:
    """Every column rendered as text, ready for a text sink."""
    return df.select(*[render_cell(F.col(f.name), f.dataType).alias(f.name)
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header row and no index column."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def replace_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """A10: render every cell and overwrite the whole table at ``path``."""
    out = render_table(df)
    if fmt == "csv":
        return write_csv(out, path)
    out.write.mode("overwrite").format(fmt).save(path)
    return path
