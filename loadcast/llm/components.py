"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadcast.session import scratch_path


def written(frame: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """The frame as a table in the shared scratch folder; cuts its lineage."""
    path = path or scratch_path(frame.sparkSession, name)
    frame.write.parquet(path, **options)
    return frame.sparkSession.read.parquet(path)


def dropped(spark, path: str) -> None:
    """Delete a table of ``written`` that a later one replaces."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternates two steps until nothing changes: every neighbour above a node
    is linked to the node's smallest neighbour, then every neighbour below it.
    A node with very many neighbours is a skewed join key, which the adaptive
    planner splits; its minimum is aggregated before the shuffle. Links and
    components stay distributed; the driver sees a count and a checksum.
    Self-links and nulls are ignored, repeated edges count once.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark = edges.sparkSession
    path, seen = scratch_path(spark, "edges"), None
    edges = written(edges, "edges", path)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(below, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        before, path = path, scratch_path(spark, "edges")
        edges = written(small, "edges", path)
        dropped(spark, before)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    # Stars now: every node but a root points at its root.
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
