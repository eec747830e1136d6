"""The corpus pipeline and the registration of its queries."""

import random

import corpus_pipeline
import __spark_entry__ as entry
from cases import awkward, nothing, words
from loadcast.llm.queries import QUERIES


def documents(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(40):
        text = "\n".join(words(rnd, 25, 4000) for _ in range(4))
        rows.append((k, text, "aa" if k % 2 else "bb", "s", len(text)))
    lines = "\n".join(words(rnd, 12, 4000) for _ in range(3))
    passage = words(rnd, 60, 4000)
    rows += [(100, rows[0][1], "bb", "s", 1),                                     # a copy: all its windows repeat
             (101, rows[1][1].replace("\n", " "), "aa", "s", 1),                 # the same words in one line
             (102, "top\n" + lines, "aa", "s", 1), (103, "other\n" + lines, "bb", "s", 1),
             (104, "first " + words(rnd, 25, 4000) + " " + passage, "aa", "s", 1),
             (105, "second " + words(rnd, 25, 4000) + " " + passage, "bb", "s", 1),
             (106, "12345", "aa", "s", 1), (107, None, None, None, None), (108, "", "bb", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_take_effect(spark):
    docs, seen = documents(spark), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "string_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(40))
    assert set(seen["language"]) == clean | {100, 101, 102, 103, 104, 105}
    assert set(seen["line_dedup"]) == clean | {101, 102, 103, 104, 105} and seen["line_dedup"][103] == "other"
    assert set(seen["near_dedup"]) == clean | {102, 103, 104, 105}
    assert seen["string_dedup"][104].startswith("first") and len(seen["string_dedup"][105]) < 200 < len(seen["near_dedup"][105])
    assert all(seen["string_dedup"][k] == seen["language"][k] for k in clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == clean | {102, 103, 104, 105}


def test_stages_on_awkward_and_empty_tables(spark):
    cols = "doc_id", "text"
    for docs in (awkward(spark).withColumnRenamed("text_", "lang").withColumnRenamed("th", "n_chars"), nothing(spark).withColumnRenamed("text_", "lang").withColumnRenamed("th", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            out.count()
            if set(cols) <= set(out.columns):
                assert out.columns == docs.columns
                docs = out


def test_queries_are_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {"op7_line_dedup", "op9_url_filter", "op13_filter_audit"} <= set(entry.oracle_sql())


def test_pipeline_runs_on_a_table(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() >= 44
