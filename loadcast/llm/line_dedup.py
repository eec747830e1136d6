"""Operator 7: line deduplication by overlapping three-line windows (built-in functions only).

Every run of three consecutive lines is a window, known by two 64-bit hashes.
The first occurrence of a window is the one with the smallest (id, text hash,
line); each line that a later occurrence covers is removed.

Windows are counted with map-side aggregation and only repeated ones are
joined back, so a window that a third of all rows share costs one row per
task; the join's side with all occurrences can be split where it is skewed.
Texts are shuffled once, when the covered lines come back to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

WINDOW = 3


def lines_of(column: str):
    return F.split(F.col(column), "\n", -1)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, th, at): the first lines of windows that occurred before. ``docs`` has key, th, lines."""
    hashes = [F.col("lines")[F.col("at") + k] for k in range(window)]
    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window))
    found = (docs.select("key", "th", "lines", F.explode(starts).alias("at"))
             .select("key", "th", "at", F.xxhash64(*hashes).alias("h1"),
                     F.xxhash64(F.lit(window), *reversed(hashes)).alias("h2")))
    place = F.struct("key", "th", "at")
    first = (found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    return found.join(first, ["h1", "h2"]).where(place > F.col("first")).select("key", "th", "at")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows with later occurrences of repeated windows removed from their texts.

    Adds n_lines (of the input text) and n_removed, in the place of columns of
    that name; all other columns stay. Lines are compared as they are, blank
    ones too; a text with fewer lines than a window has none to remove. A null
    text stays null and has 0 lines; an empty text is one empty line. A text
    whose lines are all removed becomes empty. Rows with the same id and text
    are one document: each keeps the same lines. Null ids come first.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("body"),
                       F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"))
    rows = rows.withColumn("th", F.xxhash64("body"))
    again = repeated_windows(rows.select("key", "th", lines_of("body").alias("lines")), window)
    marks = again.groupBy("key", "th").agg(F.collect_set("at").alias("starts")).select(
        F.col("key").alias("m_key"), F.col("th").alias("m_th"), "starts")
    joined = rows.join(marks, F.col("key").eqNullSafe(F.col("m_key")) & (F.col("th") == F.col("m_th")), "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1))))
    parts = joined.select("row", "body", "starts", covered.alias("covered"), lines_of("body").alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    text = F.when(F.col("starts").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n"))
    out = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own]
    return parts.select(*out,
                        F.when(F.col("body").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
                        F.when(F.col("starts").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"))


#: DuckDB twin: windows by their lines themselves.
LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, pos, lines[pos] AS a, lines[pos + 1] AS b, lines[pos + 2] AS c
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS pos FROM d)),
f AS (SELECT a, b, c, min((doc_id, pos)) AS first FROM w GROUP BY a, b, c),
later AS (SELECT w.doc_id, w.pos FROM w JOIN f USING (a, b, c) WHERE (w.doc_id, w.pos) > f.first),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest(range(3)) AS k)),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL
            ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') END AS text,
       count(l.pos)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY d.doc_id, d.text
"""
