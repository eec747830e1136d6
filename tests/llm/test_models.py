"""Operators 2, 4, 9 and 10: search, quality, URLs and languages."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import awkward, nothing
from loadcast.llm import language, multi_index, quality, url_filter
from loadcast.llm.queries import QUERIES, remainder

SF = "/root/testdata/sf0.01"


# --- search ---------------------------------------------------------------------------------

def exact_neighbours(ids, x, query, k=20):
    scores = x @ x[query]
    order = [i for i in np.lexsort((ids, -scores)) if i != query][:k]
    return [int(ids[i]) for i in order], scores[order]


def test_search_over_everything_is_exact(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(300, 9))
    x[40:100] = x[40]  # one vector that very many rows share
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 9), (902, [float("nan")] * 9), (903, [1.0] * 8), (904, [None] + [1.0] * 8),
           (905, [float("inf")] + [1.0] * 8), (None, [1.0] * 9), (920, [])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = multi_index.search(frame, F.col("id") % 20 == 0, probed=10_000).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 300, 20))
    for q, found in by.items():
        want, scores = exact_neighbours(np.arange(300), x, q)
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert np.allclose([r.score for r in found], scores)
        assert [r.vec_id for r in found] == want or np.isclose(np.diff(scores), 0).any()
    empty = multi_index.search(frame.limit(0), F.col("id") % 20 == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


def test_few_candidates_and_repeated_ids(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [-1.0, 0.0])],
                                  "vec_id long, embedding array<float>")
    got = multi_index.search(frame, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r["rank"]) for r in got] == [(1, 1), (1, 2), (2, 3)]


def test_recall_of_production_parameters(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    t = duckdb.sql(f"select vec_id, embedding from '{path}' order by vec_id").df()
    x = np.array(t.embedding.to_list(), float)
    got = multi_index.search(spark.read.parquet(path), F.col("id") % 20 == 0, probed=200).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    ids = t.vec_id.to_numpy()
    hits = [len(by[int(q)] & set(exact_neighbours(ids, x, i)[0])) for i, q in enumerate(ids) if q % 20 == 0]
    assert sum(hits) / (20 * len(hits)) >= 0.9


def test_cells_are_visited_by_summed_distance():
    rnd = np.random.default_rng(2)
    books = multi_index.Codebooks(rnd.normal(size=(6, 3)), rnd.normal(size=(5, 2)))
    sizes = rnd.integers(0, 4, 30)
    for _ in range(20):
        q = rnd.normal(size=5)
        cells = books.visit(q, sizes, int(sizes.sum()) + 1)
        cost = [-(books.first[c // 5] @ q[:3]) - books.second[c % 5] @ q[3:] for c in cells]
        assert np.all(np.diff(cost) > -1e-9) and sorted(cells) == np.flatnonzero(sizes).tolist()
        assert sizes[books.visit(q, sizes, 7)].sum() >= 7


# --- quality ----------------------------------------------------------------------------------

def test_pairs_rank_the_preferred_class_higher():
    rnd = np.random.default_rng(0)
    y = (rnd.random(800) < 0.85).astype(int)
    x = rnd.normal(size=(800, 3)) + np.outer(y, [1.5, -1.0, 0.0])
    model = quality.fit(x, y, 0.15, pairs=20_000)
    s = model.score(x)
    assert s[y == 1].mean() > s[y == 0].mean() + 0.2
    assert abs((s < quality.CUT).mean() - 0.15) < 0.02  # the cut is the quantile at the share of zeros
    for labels in (np.ones(5, int), np.zeros(5, int), np.empty(0, int)):
        flat = quality.fit(x[: len(labels)], labels, 0.0).score(x)
        assert np.unique(flat).size == 1 and flat[0] >= quality.CUT


def test_features_of_odd_texts():
    for text in ("", " ", "a", "!!!", "é\n\n", "x" * 5000, "A A A"):
        assert np.isfinite(quality.features(text)).all()
    assert quality.features("a a a a")[quality.FEATURES.index("repeats")] == 0.75
    long = "word other " * 200_000
    assert abs(quality.features(long)[quality.FEATURES.index("distinct")] - 2 / 400_000) < 1e-9


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_quality"][0](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, bad = (got.where(f"quality = {k}").agg(F.avg("predicted")).first()[0] for k in (1, 0))
    assert good > 0.98 and bad < 0.1


def test_quality_on_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 1), (4, 0), (None, 1), (6, None), (77, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    for a, b in ((docs, labels.limit(0)), (nothing(spark), labels)):
        assert quality.score(docs, quality.train(a, b)).where("score between 0 and 1").count() == docs.count()
    assert quality.score(nothing(spark), model).count() == 0


# --- languages ---------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= max(1, code.shape[1] // 5)
    assert all(0 < (column > 0).sum() < n for column in code.T)


def test_a_wrong_bit_is_corrected():
    code = language.codewords(4)
    model = language.LanguageModel(["a", "b", "c", "d"], code, np.zeros((7, 8)), np.ones(7))
    for k in range(4):
        for flip in range(7):
            wanted = 3.0 * code[k]
            wanted[flip] *= -1
            model.weights = np.tile(wanted[:, None], (1, 8))
            assert model.decode(np.array([1, 0, 0, 0, 0, 0, 0, 0]))[0] == model.languages[k]


def test_gram_counts_do_not_depend_on_slices(monkeypatch):
    text = "Straße été 漢字 abc " * 40
    whole = language.gram_counts(text)
    n = len(text.lower().encode())
    assert whole.sum() == 3 * n - 3
    monkeypatch.setattr(language, "SLICE", 7)
    assert (language.gram_counts(text) == whole).all()


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_language"][0](spark, sf).where("held_out").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99


def test_language_on_awkward_rows(spark):
    docs = awkward(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("aa")).when(F.col("doc_id") < 9, F.lit("bb")))
    model = language.train(docs)
    assert model.languages == ["aa", "bb"]
    got = language.identify(docs, model)
    assert set(docs.columns) <= set(got.columns) and got.count() == docs.count()
    for r in got.collect():
        lettered = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
    for some in (docs.limit(0), docs.where("lang = 'aa'")):
        one = language.identify(docs, language.train(some))
        assert {r.lang_pred for r in one.collect()} <= {"aa", "und"}
    assert language.identify(nothing(spark), model).count() == 0


# --- URLs ----------------------------------------------------------------------------------------

URLS = ["https://a.example.net/en/1", "https://EXAMPLE.net/en", "http://x.net", "http://x.net/", "http://x.net?y=/", "ftp://net/a#b",
        "https://shop.example.com/de/7", "https://example.com/fr/7", "http://b.org/fr/x", "http://b.org/en/x", None, "no url", "",
        "http://", "://h/p", "a://b://c/d?e", "http://İ.ORG/fr/É?q", "http://u@h:80/p;x", "x\n://h/\np", "http://h/" + "a" * 5000]


def judged(spark, urls):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://z.net/")], "page_id long, url string")
    return url_filter.judge_urls(frame.withColumn("score", F.lit(1)).withColumn("host", F.lit("clash")))


def test_url_rules_and_parts(spark):
    got = {r.page_id: r for r in judged(spark, URLS).collect()}
    assert len(got) == len(URLS) + 1
    parts = {i: (got[i].host, got[i].path) for i in range(len(URLS))}
    assert parts[1] == ("example.net", "/en") and parts[4] == ("x.net", "") and parts[5] == ("net", "/a")
    assert parts[10] == parts[11] == parts[12] == ("", "") and parts[13] == ("", "") and parts[14] == ("h", "/p")
    assert parts[15] == ("b:", "//c/d") and parts[16] == ("İ.org", "/fr/É") and parts[18] == ("h", "/\np")
    rules = [got[i].rule for i in range(10)]
    assert rules == ["example.net/en/", "net/", None, "net/", None, "net/", "example.com/de/", None, "org/fr/", None]
    assert got[0].verdict == "allow" and got[3].verdict == "block" and got[None].verdict == "block"
    assert {r.verdict for r in got.values()} == {"allow", "block"}


def test_url_models_learn_from_the_rules(spark):
    rnd = random.Random(0)
    urls = []
    for i in range(200):
        good, bad = rnd.choice(["news", "lib", "wiki"]), rnd.choice(["xxbet", "zzcash", "qqwin"])
        urls += [f"http://{good}{i}.org/fr/{good}", f"http://{bad}{i}.net/{bad}", f"http://{good}{i}.io/{good}", f"http://{bad}{i}.io/{bad}"]
    got = {r.page_id: r.verdict for r in judged(spark, urls).collect()}
    right = [got[i] == ("allow" if i % 2 == 0 else "block") for i in range(len(urls)) if i % 4 >= 2]
    assert sum(right) / len(right) > 0.97


def test_url_filter_without_examples_and_without_rows(spark):
    got = judged(spark, ["http://a.io/1", "http://a.io/1"]).where("page_id is not null").collect()
    assert len(got) == 2 and len({r.verdict for r in got}) == 1
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty).count() == 0


def test_url_filter_runs_no_python(spark):
    plan = judged(spark, URLS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_remainder_of_null_ids(spark):
    got = spark.createDataFrame([(None,), (5,)], "doc_id long").select(remainder(5).alias("r")).collect()
    assert got[0].r is None and got[1].r in range(5)
