"""Incremental refresh of a daily table from files arriving in a folder.

The reference re-reads its whole source every few minutes. Here new files
are picked up by a Structured Streaming file source; each micro-batch is
coerced and appended under ``batch=<id>`` (overwriting that one folder, so a
retried batch is idempotent). The current table is the latest row per key
across batches (``max_by`` over the batch id: a partial aggregate, one row per
key and task crosses the shuffle); rows marked deleted drop out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loadcast import schema as S
from loadcast.sources import ingest as io

DELETED = "_deleted"


def _prepare(batch: DataFrame, numeric: list[str]) -> DataFrame:
    out = io.coerce_date(batch, S.DATE)
    out = io.coerce_numeric(out, numeric)
    if DELETED not in out.columns:
        out = out.withColumn(DELETED, F.lit(False))
    else:
        out = out.withColumn(DELETED, F.coalesce(F.col(DELETED).cast("boolean"), F.lit(False)))
    return out.where(F.col(S.DATE).isNotNull())


def start_refresh(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_dir: str,
                  schema: T.StructType = S.RAW_DAILY_SCHEMA,
                  numeric: list[str] | None = None, every: str = "300 seconds",
                  available_now: bool = False) -> StreamingQuery:
    """Start the stream: CSV files with a header in ``source_dir`` -> batches in ``table_dir``."""
    numeric = numeric or S.NUMERIC_INPUTS
    src = spark.readStream.schema(schema).option("header", True).csv(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = _prepare(batch, numeric).withColumn("_batch", F.lit(batch_id).cast("long"))
        out.write.mode("overwrite").parquet(f"{table_dir.rstrip('/')}/batch={batch_id}")

    writer = src.writeStream.foreachBatch(write_batch).option("checkpointLocation",
                                                              checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=every)
    return writer.start()


def current_table(spark: SparkSession, table_dir: str,
                  key: list[str] | None = None) -> DataFrame:
    """Latest row per key over all batches; deleted keys removed.

    Of a key's rows in one batch the one with the largest values counts.
    """
    key = key or [S.SERIES, S.DATE]
    hist = spark.read.parquet(table_dir)
    cols = [c for c in hist.columns if c not in key + ["batch", "_batch"]]
    row = F.struct(*[F.col(c) for c in cols])
    latest = hist.groupBy(*key).agg(
        F.max_by(row, F.struct(F.col("_batch"), row)).alias("_row"))
    out = latest.select(*key, "_row.*")
    return out.where(~F.col(DELETED)).drop(DELETED)
