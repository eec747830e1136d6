"""Operator 9: URL filter by rules and a character language-model ratio (built-in functions only).

Rules decide what they fit. For the other URLs, two smoothed variable-order
Markov models over the characters of host and path, one of accepted and one
of rejected URLs, give a log-likelihood difference per character. Each model
mixes the orders: ``p_k = (n_k + weight * p_(k-1)) / (context_k + weight)``,
down to a uniform distribution, so an unseen context falls back to a shorter one.

The models are counted over every URL that a rule decides, as a table of
distinct grams with map-side aggregation; lower orders are sums over that
table. Equal URLs are scored once. The threshold is where the scores of
accepted and rejected URLs are as many standard deviations away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loadcast.session import scratch_path

ORDER = 4
WEIGHT = 2.0

#: The rules of the registered query (fixed values): (action, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` or a parent domain and starts ``path``, and its action."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(action)
    return rule, action


def gram_scores(counts: DataFrame, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """(gram, llr) from (gram, a, b): the log ratio of the last character's probabilities after the others."""
    totals = {}
    for k in range(1, order + 1):
        totals[k] = (counts.groupBy(F.substring("gram", order - k + 1, k).alias(f"g{k}"))
                     .agg(F.sum("a").alias(f"a{k}"), F.sum("b").alias(f"b{k}")))
    contexts = {k: (counts.groupBy(F.substring("gram", order - k + 1, k - 1).alias(f"c{k}"))
                    .agg(F.sum("a").alias(f"ca{k}"), F.sum("b").alias(f"cb{k}"))) for k in range(2, order + 1)}
    # The first order: one row a character, so its totals are those of few rows.
    letters = totals[1].select("g1", "a1", "b1", F.expr("sum(a1) over ()").alias("ca1"),
                               F.expr("sum(b1) over ()").alias("cb1"), F.expr("count(1) over ()").alias("size"))
    table = counts.select("gram", *(F.substring("gram", order - k + 1, k).alias(f"g{k}") for k in range(1, order + 1)),
                          *(F.substring("gram", order - k + 1, k - 1).alias(f"c{k}") for k in range(2, order + 1)))
    table = table.join(letters, "g1")
    for k in range(2, order + 1):
        table = table.join(totals[k], f"g{k}").join(contexts[k], f"c{k}")

    def probability(side: str) -> Column:
        p = (F.col(f"{side}1") + weight / F.col("size")) / (F.col(f"c{side}1") + weight)
        for k in range(2, order + 1):
            p = (F.col(f"{side}{k}") + weight * p) / (F.col(f"c{side}{k}") + weight)
        return p

    return table.select("gram", (F.ln(probability("a")) - F.ln(probability("b"))).alias("llr"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url",
               order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """(id, host, path, rule, verdict, score, threshold), one row per row.

    Null URLs and those without ``://`` have empty hosts and paths; no rule
    fits them and the models judge the empty text. Repeated rows and null ids
    are judged like others; an empty table gives an empty result. With no
    accepted or no rejected URL the threshold is 0. URLs of any length are
    read whole.
    """
    rule, action = rule_of(rules)
    judged = (pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"))
              .select("key", host_of("url").alias("host"), path_of("url").alias("path"))
              .select("key", "host", "path", rule.alias("rule"), action.alias("action")))
    judged = judged.withColumns({"k1": F.xxhash64("host", "path"), "k2": F.xxhash64("path", "host")})
    texts = judged.groupBy("k1", "k2").agg(
        F.first("host").alias("host"), F.first("path").alias("path"),
        F.count(F.when(F.col("action") == "allow", 1)).alias("a"),
        F.count(F.when(F.col("action") == "block", 1)).alias("b"))
    edge = "\x02" * (order - 1)
    letters = F.split(F.concat(F.lit(edge), "host", "path", F.lit("\x03")), "")
    spread = texts.select("k1", "k2", "a", "b", F.filter(letters, lambda x: x != "").alias("letters"))
    grams = F.transform(F.sequence(F.lit(0), F.size("letters") - order),
                        lambda i: F.concat(*(F.col("letters")[i + k] for k in range(order))))
    spread = spread.select("k1", "k2", "a", "b", F.explode(grams).alias("gram"))
    counts = spread.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    scored = (spread.join(gram_scores(counts, order, weight), "gram")
              .groupBy("k1", "k2").agg(F.avg("llr").alias("score"), F.first("a").alias("a"), F.first("b").alias("b")))
    path = scratch_path(pages.sparkSession, "url-scores")
    scored.write.parquet(path)
    scored = pages.sparkSession.read.parquet(path)
    side = {s: F.when(F.col(s) > 0, F.col("score")) for s in "ab"}
    fit = scored.agg(*(f(side[s]).alias(n + s) for s in "ab" for n, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
    threshold = threshold_of(fit["ma"], fit["da"], fit["mb"], fit["db"])
    scores = scored.select("k1", "k2", "score")
    found = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return (judged.join(scores, ["k1", "k2"], "left")
            .select(F.col("key").alias(id_col), "host", "path", "rule", F.coalesce("action", found).alias("verdict"),
                    "score", F.lit(float(threshold)).alias("threshold")))


def threshold_of(mean_a, dev_a, mean_b, dev_b) -> float:
    """As many standard deviations below the accepted mean as above the rejected one."""
    if mean_a is None or mean_b is None:
        return 0.0
    if dev_a + dev_b == 0:
        return (mean_a + mean_b) / 2
    return (mean_a * dev_b + mean_b * dev_a) / (dev_a + dev_b)


def _url_sql() -> str:
    """DuckDB twin of :func:`judge_urls` for the registered rules."""
    cases = {"rule": "", "action": ""}
    for kind, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        cases["rule"] += f" WHEN {fits} THEN '{text}'"
        cases["action"] += f" WHEN {fits} THEN '{kind}'"
    n, w = ORDER, WEIGHT
    sums = ", ".join(
        f"sum(a) OVER (PARTITION BY substr(gram, {n - k + 1}, {k})) AS a{k}, "
        f"sum(b) OVER (PARTITION BY substr(gram, {n - k + 1}, {k})) AS b{k}, "
        f"sum(a) OVER (PARTITION BY substr(gram, {n - k + 1}, {k - 1})) AS ca{k}, "
        f"sum(b) OVER (PARTITION BY substr(gram, {n - k + 1}, {k - 1})) AS cb{k}" for k in range(1, n + 1))

    def probability(s: str) -> str:
        p = f"(({s}1 + {w}::DOUBLE / size) / (c{s}1 + {w}::DOUBLE))"
        for k in range(2, n + 1):
            p = f"(({s}{k} + {w}::DOUBLE * {p}) / (c{s}{k} + {w}::DOUBLE))"
        return p

    return f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, CASE{cases['rule']} END AS rule, CASE{cases['action']} END AS action FROM p),
t AS (SELECT host, path, count(*) FILTER (WHERE action = 'allow') AS a,
             count(*) FILTER (WHERE action = 'block') AS b,
             repeat(chr(2), {n - 1}) || host || path || chr(3) AS s FROM j GROUP BY host, path),
e AS (SELECT host, path, a, b, substr(s, i, {n}) AS gram
      FROM (SELECT *, unnest(range(1, length(s) - {n - 2})) AS i FROM t)),
g AS (SELECT gram, sum(a) AS a, sum(b) AS b FROM e GROUP BY gram),
s AS (SELECT gram, {sums}, (SELECT count(DISTINCT substr(gram, {n}, 1)) FROM g) AS size FROM g),
r AS (SELECT gram, ln({probability('a')}) - ln({probability('b')}) AS llr FROM s),
u AS (SELECT host, path, any_value(a) AS a, any_value(b) AS b, avg(llr) AS score
      FROM e JOIN r USING (gram) GROUP BY host, path),
m AS (SELECT avg(score) FILTER (WHERE a > 0) AS ma, stddev_pop(score) FILTER (WHERE a > 0) AS da,
             avg(score) FILTER (WHERE b > 0) AS mb, stddev_pop(score) FILTER (WHERE b > 0) AS db FROM u),
h AS (SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN 0 WHEN da + db = 0 THEN (ma + mb) / 2
                  ELSE (ma * db + mb * da) / (da + db) END AS threshold FROM m)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.action, CASE WHEN u.score >= (SELECT threshold FROM h) THEN 'allow' ELSE 'block' END) AS verdict
FROM j JOIN u ON j.host = u.host AND j.path = u.path
"""


URL_SQL = _url_sql()
