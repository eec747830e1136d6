"""Operator 10: language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit one classifier over
hashed byte n-grams (1 to 3) tells the languages with +1 from those with -1:
its weights are the log ratio of the two sides' smoothed gram distributions,
in which every language counts the same. A text's margins are the mean
weights of its grams. Decoding sums, over the bits, the logistic loss of the
margin against the codeword, weighted by how far apart the bit's two sides
are; the codeword of least loss wins and a small lead flags ambiguity.

Training is one aggregation over all learnable rows: a task adds up the gram
counts of its rows by language and emits one row per language and bucket.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from loadcast.llm.workers import map_arrow

BUCKETS = 8192
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"

#: Bytes of a text whose grams are counted at once.
SLICE = 1 << 20

#: A lead in loss below this is ambiguous.
LEAD = 0.05


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of a text's byte n-grams of lengths 1 to 3 by hash bucket."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    total = np.zeros(buckets, np.int64)
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE + 2].astype(np.uint32)
        grams = part[:SLICE].copy()
        for n in (1, 2, 3):
            if n > 1:
                grams = grams[: len(part) - n + 1] * np.uint32(256) + part[n - 1 :][: len(grams)]
            mixed = (grams[:SLICE] + np.uint32(n << 28)) * np.uint32(2654435761)
            total += np.bincount(mixed >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    return total


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +1/-1 per language: the exhaustive code up to 7 languages, else the best of seeded random ones."""
    if n <= 7:
        width = max(1, 2 ** (max(n, 2) - 1) - 1)
        rows = [[1] * width]
        for k in range(1, n):
            run = 2 ** (n - k - 1)
            rows.append([-1 if (j // run) % 2 == 0 else 1 for j in range(width)])
        return np.array(rows[:n], np.float64)
    rng, width, best, apart = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n))), None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        likeness = code @ code.T
        np.fill_diagonal(likeness, -width)
        mixed = np.abs(code.sum(axis=0)).max() < n
        if mixed and width - likeness.max() > apart:
            best, apart = code, width - likeness.max()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # bits x buckets
    trust: np.ndarray     # bits, mean 1

    def decode(self, counts: np.ndarray) -> tuple[str, float, bool, str]:
        """(language, score, ambiguous, runner-up) of a text's gram counts."""
        if len(self.languages) < 2:
            return (self.languages[0] if self.languages else UNDETERMINED), float(len(self.languages)), False, None
        used = np.flatnonzero(counts)
        n = counts[used]
        margins = self.weights[:, used] @ n / np.sqrt(n.sum())
        losses = np.logaddexp(0.0, -self.code * margins) @ self.trust
        order = np.argsort(losses, kind="stable")
        share = np.exp(losses[order[0]] - losses)
        lead = float(losses[order[1]] - losses[order[0]])
        return self.languages[order[0]], float(1.0 / share.sum()), lead < LEAD, self.languages[order[1]]


def fit(languages: list[str], counts: np.ndarray, smoothing: float = 0.5) -> LanguageModel:
    """The model of gram counts (languages x buckets)."""
    code = codewords(len(languages)) if languages else np.empty((0, 0))
    spread = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True) if languages else counts
    if len(languages) < 2:
        return LanguageModel(languages, code, np.empty((0, 0)), np.empty(0))
    plus, minus = (code > 0).T.astype(float), (code < 0).T.astype(float)
    p = plus @ spread / plus.sum(axis=1, keepdims=True)
    q = minus @ spread / minus.sum(axis=1, keepdims=True)
    middle = (p + q) / 2
    apart = (p * np.log(p / middle) + q * np.log(q / middle)).sum(axis=1)
    return LanguageModel(languages, code, np.log(p) - np.log(q), apart / apart.mean())


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS) -> LanguageModel:
    """Learn from all rows with a language and a text with a letter.

    What comes to the driver is one row per language and bucket, however many
    rows there are. Null texts and languages are passed over.
    """
    def rows(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if LETTER.search(text):
                    own = gram_counts(text, buckets)
                    totals[lang] = totals[lang] + own if lang in totals else own
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()),
                                              pa.array(total[used], pa.int64())], ["lang", "bucket", "n"])

    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = (map_arrow(known.dropna(), rows, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), buckets))
    at = {lang: k for k, lang in enumerate(languages)}
    counts[sums["lang"].map(at).to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"].to_numpy(float)
    return fit(languages, counts)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred, score, ambiguous and runner_up, in the place of columns of that name.

    A null text or one without a letter is ``und`` with score 0. One row per
    row, repeated and empty ones included; texts are read whole.
    """
    names = ["lang_pred", "score", "ambiguous", "runner_up"]
    own = [c for c in docs.columns if c not in names]
    buckets = model.weights.shape[1] if model.weights.size else BUCKETS
    buckets = 1 << (buckets.bit_length() - 1)

    def judge(text):
        if text is None or not LETTER.search(text):
            return UNDETERMINED, 0.0, False, None
        return model.decode(gram_counts(text, buckets))

    def rows(batches):
        for batch in batches:
            found = [judge(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            a, b, c, d = zip(*found, strict=True) if found else ([], [], [], [])
            new = [pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.bool_()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], *names])

    kept = [f"c{k}" for k in range(len(own))]
    picked = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(own, kept, strict=True)),
                         F.col(text_col).cast("string").alias("judged"))
    schema = ", ".join([*(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(own, kept, strict=True)),
                        "lang_pred string", "score double", "ambiguous boolean", "runner_up string"])
    out = map_arrow(picked, rows, schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(own, kept, strict=True)), *names)
