"""The registered queries of this subpackage: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadcast.llm import (byte_bpe, conversations, filter_audit, html_text, language, line_dedup, minhash, multi_index, packing, quality,
                          simhash, suffix_dedup, url_filter)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int):
    """crc32 of the id as text; a null id has remainder null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_dart_minhash(spark, sf_dir):
    return minhash.near_classes(table(spark, sf_dir, "documents"))


def op2_multi_index(spark, sf_dir):
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_run_length(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "kept_text")


def op4_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learnable = remainder(5) != 0
    model = quality.train(docs.where(learnable), labels.where(learnable))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_simhash(spark, sf_dir):
    return simhash.compare_with_next(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_byte_bpe(spark, sf_dir):
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                     public_tokenizers.PATTERN, digests=True)


def op9_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(remainder(4) != 2))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous", "runner_up")


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with a tenth of their rows spoilt or more, by crc32(conv_id:turn) % 20; ``present`` is false for dropped rows."""
    blank = F.lit(" ")
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    spoilt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(place.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))
    return spoilt.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                         (kind != 0).alias("present"), copies.alias("copy")).drop("copy")


def op11_conversations(spark, sf_dir):
    return conversations.repair(damage(table(spark, sf_dir, "conversations")), present=F.col("present"))


def op12_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_dart_minhash": (op1_dart_minhash, None),
    "op2_multi_index": (op2_multi_index, None),
    "op3_run_length": (op3_run_length, None),
    "op4_quality": (op4_quality, None),
    "op5_packing": (op5_packing, None),
    "op6_simhash": (op6_simhash, None),
    "op7_line_dedup": (op7_line_dedup, line_dedup.LINE_DEDUP_SQL),
    "op8_byte_bpe": (op8_byte_bpe, None),
    "op9_url_filter": (op9_url_filter, url_filter.URL_SQL),
    "op10_language": (op10_language, None),
    "op11_conversations": (op11_conversations, None),
    "op12_html_text": (op12_html_text, None),
    "op13_filter_audit": (op13_filter_audit, filter_audit.AUDIT_SQL),
}
