"""Change sets between an edited table and its original, and keyed upserts.

The reference compares rows by position; here rows are matched by key. Both
tables are tagged, put together and grouped by the key: one shuffle with
map-side aggregation and no join. Grouping treats null key values as equal,
so keys with nulls match like any other, and it counts the rows of a key, so
a repeated key is an error instead of a silent cross product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcast.operators.ranking import global_positions

INSERT, UPDATE, DELETE, SAME = "insert", "update", "delete", "same"


def drop_internal(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A5: remove derived columns (by default ``month``) before saving."""
    cols = cols or ["month"]
    return df.drop(*[c for c in cols if c in df.columns])


def changed_rows(new: DataFrame, old: DataFrame, key: list[str],
                 compare: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Every key of either side with its change kind.

    Output: key columns, ``kind`` (insert / update / delete / same), the new
    values of the compared columns (old values for deletes) and ``changed``,
    the list of compared columns whose value differs (null-safe). ``carry``
    names further columns of ``old`` whose values come along unchanged (null
    for inserts). A key that one side holds twice raises an error.
    """
    compare = compare or [c for c in new.columns if c not in key and c in old.columns]
    carry = [c for c in carry or [] if c not in key and c not in compare]

    def side(df: DataFrame, mine: str, other: str) -> DataFrame:
        cols = [F.col(c).cast(old.schema[c].dataType).alias(c) for c in compare]
        kept = [F.col(c) if df is old else F.lit(None).cast(old.schema[c].dataType).alias(c)
                for c in carry]
        row = F.struct(F.lit(1).alias("here"), *cols, *kept)
        keys = [F.col(k).cast(old.schema[k].dataType).alias(k) for k in key]
        out = df.select(*keys, row.alias(mine))
        return out.withColumn(other, F.lit(None).cast(out.schema[mine].dataType))

    both = side(new, "_n", "_o").unionByName(side(old, "_o", "_n"))
    j = both.groupBy(*key).agg(
        F.first("_n", ignorenulls=True).alias("_n"), F.first("_o", ignorenulls=True).alias("_o"),
        F.greatest(F.count("_n"), F.count("_o")).alias("_rows"))
    twice = F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*key))))
    n_here, o_here = F.col("_n").isNotNull(), F.col("_o").isNotNull()
    differs = [F.when(~F.col(f"_n.{c}").eqNullSafe(F.col(f"_o.{c}")), F.lit(c)) for c in compare]
    names = F.filter(F.array(*differs), lambda x: x.isNotNull())
    kind = (F.when(F.col("_rows") > 1, twice.cast("string"))
            .when(~o_here, F.lit(INSERT)).when(~n_here, F.lit(DELETE))
            .when(F.size(names) > 0, F.lit(UPDATE)).otherwise(F.lit(SAME)))
    vals = [F.when(n_here, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in compare]
    changed = F.when(n_here & o_here, names).otherwise(F.array().cast("array<string>"))
    return j.select(*key, kind.alias("kind"), *vals, *[F.col(f"_o.{c}").alias(c) for c in carry],
                    changed.alias("changed"))


def changed_columns(changes: DataFrame) -> DataFrame:
    """``(column_name, n_changed)`` for compared columns with any update."""
    return (changes.where(F.col("kind") == UPDATE)
            .select(F.explode("changed").alias("column_name"))
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("n_changed")))


def group_consecutive(df: DataFrame, n: str, keys: list[str] | None = None,
                      num_partitions: int | None = None) -> DataFrame:
    """Consecutive integer values of ``n`` grouped into ranges (gaps and islands).

    Output ``(*keys, range_start, range_end, n_rows)``. Values must be unique
    per group. Within a group, ``n`` minus its position is the same for all
    values of a range and different between ranges. Positions are those of one
    distributed sort of all rows (:func:`ranking.global_positions`): a group's
    first position only shifts them, so no task holds a whole group, however
    hot it is, and nothing is chained.
    """
    keys = keys or []
    vals = df.select(*keys, F.col(n).cast("long").alias(n))
    pos = global_positions(vals, [*keys, n], num_partitions)
    return (pos.groupBy(*keys, (F.col(n) - F.col("_gpos")).alias("_island")).agg(
        F.min(n).alias("range_start"), F.max(n).alias("range_end"),
        F.count(F.lit(1)).alias("n_rows")).drop("_island"))


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Base rows without a change, plus inserted and updated rows.

    ``changes`` is the output of :func:`changed_rows` (or any frame with the
    key, ``kind`` and the base columns). Rows of kind ``same`` are left as in
    the base; deletes remove the key. Idempotent: applying the same change set
    twice gives the same table. One full outer join, with null-safe keys.
    """
    cols = base.columns
    c = changes.where(F.col("kind") != SAME).select(*[F.col(x).alias(f"_c_{x}") for x in cols],
                                                    F.col("kind").alias("_kind"))
    same = None
    for k in key:
        x = F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        same = x if same is None else same & x
    j = base.join(c, same, "full_outer").where(
        F.col("_kind").isNull() | (F.col("_kind") != DELETE))
    return j.select(*[F.when(F.col("_kind").isNull(), F.col(x)).otherwise(F.col(f"_c_{x}"))
                      .alias(x) for x in cols])


def merge(base: DataFrame, edited: DataFrame, key: list[str],
          compare: list[str] | None = None) -> DataFrame:
    """A6 + A9 in one pass: the base with the edits applied, from one grouping by key.

    Every key of the edited table is kept with its values, keys that are gone
    from it are removed, and base columns that the edited table lacks stay.
    """
    compare = compare or [c for c in base.columns if c in edited.columns and c not in key]
    d = changed_rows(edited, base, key, compare, carry=base.columns)
    return d.where(F.col("kind") != DELETE).select(*base.columns)


def write_upsert(base_path: str, changes: DataFrame, key: list[str], out_path: str,
                 fmt: str = "parquet") -> str:
    """A9 as a table write: the merged table goes to a new path (then swapped by
    the caller), so a failed job never leaves a half-written base."""
    spark = changes.sparkSession
    base = spark.read.format(fmt).load(base_path)
    upsert(base, changes, key).write.mode("overwrite").format(fmt).save(out_path)
    return out_path
