"""The corpus pipeline: each stage works on all that the one before it kept.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadcast.llm import language, line_dedup, minhash, packing, suffix_dedup
from loadcast.session import scratch_path


def own_columns(docs: DataFrame) -> list:
    """The columns by their names as they are, dots included."""
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose two best languages decode alike, go.

    Null and empty texts have no letter. Repeated rows are judged alike; columns of any name stay.
    Rows without a language are not learnt from; an empty table stays empty.
    """
    judged = language.identify(docs, language.train(docs))
    known = (F.col("lang_pred") != language.UNDETERMINED) & ~F.col("ambiguous")
    return judged.where(known).select(*own_columns(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose later occurrences of three-line windows; documents that lose all their text go.

    Null and empty texts lose nothing and stay. Rows with the same id and text keep the same lines;
    null ids come first. Columns of any name stay, n_chars is counted anew.
    """
    cut = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", "\\s", " ")) != "")
    return cut.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*own_columns(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of the smallest id.

    Null texts and ones without words are like no other. Of rows with one id the one of the smallest
    text stays; rows with a null id all stay. Columns of any name stay.
    """
    return minhash.keep_one(docs)


def dedup_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose strings of 50 bytes that an earlier document holds; documents that lose all go.

    A null text becomes empty and stays. Rows with one id take nothing from each other, null ids
    neither lose nor remove. Of rows with the same id and text one's columns are carried along.
    """
    others = {c: f"x{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    named = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(x) for c, x in others.items()))
    cut = suffix_dedup.remove_repeats(named, carry=tuple(others.values())).where("n_removed = 0 or n_removed < n_bytes")
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(made[c] if c in made else F.col(others[c]) for c in docs.columns)).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 4096 tokens.

    A null or empty text is its end token alone; repeated rows and null ids are documents of their
    own. Other columns play no part.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("string_dedup", dedup_strings),
    ("packing", pack_sequences),
]

#: The stages that classify, compare signatures and tokenise have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
