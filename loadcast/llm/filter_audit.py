"""Operator 13: how five document filters interact, in every order in which they can be applied.

Words are counted in a sparse document-term matrix (``term_matrix``): a row's
sum decides filter A, its number of entries filter B. The flags of C and D and
a digest of the text are taken where the text is read and ride along with the
matrix, so no text is shuffled. A document is then five bits, and a part of
the corpus at most 32 counts, from which all orders follow.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from loadcast.llm.term_matrix import row_sizes

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SYMBOLS = b"#$%&*|"


def measure(texts: pa.Array) -> pa.StructArray:
    """Flags c and d of texts, from the bytes of the whole array: shares of capitals, and any symbol."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]

    def per_text(kind):
        running = np.zeros(len(body) + 1, np.int64)
        np.cumsum(kind[body], out=running[1:])
        return np.diff(running[offsets - offsets[0]])

    codes = np.arange(256)
    capitals = per_text((codes >= ord("A")) & (codes <= ord("Z")))
    points = per_text((codes & 0xC0) != 0x80)  # bytes that begin a code point
    symbols = per_text(np.isin(codes, np.frombuffer(SYMBOLS, np.uint8)))
    return pa.StructArray.from_arrays([pa.array(100 * capitals > MAX_CAPITALS * points), pa.array(symbols > 0)], ["c", "d"])


def failures(docs: DataFrame) -> DataFrame:
    """(id, part, digest, fails) of each document: bits 0 to 3 of ``fails`` are filters A to D.

    A: under 200 words. B: fewer than half the words are different. C: more
    than 3 % of the code points are ``[A-Z]``. D: any of ``#$%&*|``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    sizes = row_sizes(read, measure=measure, measured="c:boolean,d:boolean")
    bits = (F.when(F.col("n_words") < MIN_WORDS, 1).otherwise(0)
            + F.when(100 * F.col("n_terms") < MIN_DISTINCT * F.col("n_words"), 2).otherwise(0)
            + F.when(F.col("doc.measured.c"), 4).otherwise(0) + F.when(F.col("doc.measured.d"), 8).otherwise(0))
    return sizes.select("doc.row.id", "doc.row.part", "doc.row.digest", bits.alias("fails"))


def tally(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents by part and set of failed filters, E (bit 4) included.

    A digest's documents are counted by their first four bits before its
    smallest id is looked for, so that a group of copies of any size is a few
    rows. A null id has no smaller one and is no smaller one.
    """
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = flags.join(marks, "id", "left")
    kind = ["digest", "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # No key is hot here: the id is one of the keys.
    by_id = known.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    by_text = by_id.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first.alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    unique = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = by_text.withColumn("least", least).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("fails"), unique.alias("n")),
        F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - unique).alias("n")))).alias("s"))
    n = F.col("s.n")
    return split.groupBy("part", F.col("s.fails").alias("fails")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step from counts (part, fails, n, good, toxic); see ``audit``."""
    orders = F.array(*(F.lit("".join(order)) for order in permutations(filters)))
    letters = F.concat(*(F.when(F.col("fails").bitwiseAND(1 << k) != 0, f).otherwise("") for k, f in enumerate(filters)))
    each = (counts.withColumn("letters", letters)
            .withColumn("filter_order", F.explode(orders))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
            .withColumn("own", F.expr("substring(filter_order, step, 1)")))
    fails = F.contains(F.col("letters"), F.col("own"))
    gone = F.expr("translate(letters, substring(filter_order, 1, step - 1), '')") != F.col("letters")

    def total(what, where, name):
        return F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long").alias(name)

    out = each.groupBy("part", "filter_order", "step", "own").agg(
        total("n", ~fails & ~gone, "kept"), total("n", fails & ~gone, "removed"), total("n", fails & gone, "redundant"),
        total("n", F.col("letters") == F.col("own"), "unique_fails"),
        total("good", fails & ~gone, "good_lost"), total("toxic", fails & ~gone, "toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of five filters removes at each step of each of their 120 orders, by language.

    ``(part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley)``: documents of a part that are left after
    the step, that it removes, that fail its filter but went earlier, that
    fail its filter alone, removed ones labelled good or toxic, and what the
    filter removes over all orders. Filters A to D: see ``failures``; E: the
    text is that of a smaller doc_id anywhere in the table.

    Null texts are empty, a null language is the part "". Rows that share an
    id are documents of their own and no copies of each other; a null id
    fails E never and has no label. Of several labels of an id any counts. Columns other than
    doc_id, text and lang play no part. An empty table has no parts.
    """
    return interactions(tally(failures(docs), labels))


#: DuckDB twin.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (len(words) < 200)::INT AS a,
             (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
             (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT AS c,
             regexp_matches(t, '[#$%&*|]')::INT AS d,
             coalesce(doc_id > least, false)::INT AS e
      FROM w LEFT JOIN l USING (doc_id)),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT s1.x || s2.x || s3.x || s4.x || s5.x AS filter_order FROM s s1, s s2, s s3, s s4, s s5
      WHERE len(list_distinct([s1.x, s2.x, s3.x, s4.x, s5.x])) = 5),
p AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
m AS (SELECT part, good, toxic, count(*) AS n,
             (CASE a WHEN 1 THEN 'A' ELSE '' END) || (CASE b WHEN 1 THEN 'B' ELSE '' END) || (CASE c WHEN 1 THEN 'C' ELSE '' END)
             || (CASE d WHEN 1 THEN 'D' ELSE '' END) || (CASE e WHEN 1 THEN 'E' ELSE '' END) AS fails
      FROM f GROUP BY ALL),
j AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, n, good, toxic, fails,
             contains(fails, substr(filter_order, step, 1)) AS hit,
             step > 1 AND translate(fails, substr(filter_order, 1, step - 1), '') <> fails AS gone
      FROM m, p),
r AS (SELECT part, filter_order, step::INTEGER AS step, own,
             coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(n) FILTER (WHERE hit AND NOT gone AND good = 1), 0)::BIGINT AS good_lost,
             coalesce(sum(n) FILTER (WHERE hit AND NOT gone AND toxic = 1), 0)::BIGINT AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
