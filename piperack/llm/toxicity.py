"""Toxicity: cumulative-link ordinal regression from sparse text features.

P(grade >= k) is the logistic function of w.x - threshold_k: one weight vector serves all thresholds, which are
ordered. x holds, for each word of a bounded vocabulary, the logarithm of one plus its occurrences in the whole text.
The expected severity is the sum of the probabilities over k.

The vocabulary is the ``vocabulary`` words whose document counts differ most between toxic and other labelled
documents, by a one-degree chi-square, counted by Spark over the sample. Labels of 0 and 1 carry no severity of their
own; toxic documents are graded 1 to 3 by the occurrences of such words, cut at the terciles of the toxic
documents. Ordinal labels may be given as they are.

The model is fitted on the driver on at most ``max_rows`` labelled rows, taken in the order of a hash of their ids.

Cases: a null or empty text has no words, its severity follows from the thresholds; a document labelled twice counts
once, with the higher label, and of an id with different texts the least counts do; without labels of both kinds all severities are 0; repeated rows give repeated rows; an
empty table gives an empty table; output columns replace columns of the same names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piperack.llm.decontamination import words_of
from piperack.llm.quality import labelled_sample
from piperack.llm.textcut import raw_rows

MAX_ROWS, VOCABULARY, GRADES = 20_000, 1024, 4


def distinct_words(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([list({w.decode() for w in words_of(raw)}) for raw in raw_rows(texts)], pa.list_(pa.string()))

    return of(F.coalesce(text, F.lit("")))


def _counts(raw: bytes | None, number: dict[bytes, int]) -> dict[int, int]:
    found = Counter(w for w in words_of(raw) if w in number)
    return {number[w]: n for w, n in found.items()}


@dataclass
class OrdinalModel:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, one row a document."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds[None], -35, 35)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, words: list[str], grades: int = GRADES, steps: int = 400, ridge: float = 0.02, lasso: float = 5e-5) -> OrdinalModel:
    """Weights and ordered thresholds by proximal gradient steps with per-coordinate rates over sparse triples."""
    n, k = len(y), grades - 1
    share = np.array([(np.sum(y >= g + 1) + 0.5) / (n + 1) for g in range(k)])
    theta = -np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(k))
    if not n or (y > 0).sum() in (0, n):
        return OrdinalModel(words, np.zeros(len(words)), np.full(k, 35.0) if not (y > 0).any() else theta)
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    w = np.zeros(len(words))
    state = [np.zeros(len(words)), np.zeros(1 + len(gaps))]
    for _ in range(steps):
        theta = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        margin = np.bincount(rows, values * w[cols], n)
        at = 1 / (1 + np.exp(-np.clip(margin[:, None] - theta[None], -35, 35)))  # P(grade >= k)
        full = np.concatenate((np.ones((n, 1)), at, np.zeros((n, 1))), axis=1)
        slope = np.concatenate((np.zeros((n, 1)), at * (1 - at), np.zeros((n, 1))), axis=1)
        index = np.arange(n)
        p = np.maximum(full[index, y] - full[index, y + 1], 1e-9)
        upper, lower = slope[index, y] / p, slope[index, y + 1] / p
        g_margin = -(upper - lower) / n
        g_theta = np.array([np.sum(upper[y == j + 1]) - np.sum(lower[y == j]) for j in range(k)]) / n
        gw = np.bincount(cols, values * g_margin[rows], len(words)) + ridge * w / n
        g_free = np.concatenate(([g_theta.sum()], [np.exp(gaps[j]) * g_theta[j + 1 :].sum() for j in range(len(gaps))]))
        for s, g in zip(state, (gw, g_free), strict=True):
            s += g**2
        rate = 0.5 / np.sqrt(state[0] + 1e-12)
        w = w - rate * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
        step = 0.3 * g_free / np.sqrt(state[1] + 1e-12)
        first, gaps = first - step[0], np.clip(gaps - step[1:], -6, 4)
    return OrdinalModel(words, w, first + np.concatenate(([0], np.cumsum(np.exp(gaps)))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, vocabulary: int = VOCABULARY, grades: int = GRADES, text: str = "text") -> OrdinalModel:
    """The model of the labelled documents; collects ``vocabulary`` words and the sample's counts of those."""
    ids = labelled_sample(labels, label, max_rows, least=False)
    sample = docs.select("doc_id", text).join(F.broadcast(ids), "doc_id")
    per_word = sample.select("__label", F.explode(distinct_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("__label") > 0).cast("long")).alias("t"))
    totals = ids.agg(F.count(F.lit(1)), F.sum((F.col("__label") > 0).cast("long"))).first()
    n, t = totals[0], totals[1] or 0
    if not 0 < t < n:
        return fit_ordinal(np.empty(0, int), np.empty(0, int), np.empty(0), np.full(n, int(t > 0)), [], grades)
    rate = F.lit(t / n)
    gap = F.col("t") - F.col("n") * rate
    chi = gap * gap / (F.col("n") * rate * (1 - rate) * (1 - F.col("n") / (n + 1)))
    best = per_word.where("n >= 3").select("word", "n", "t", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(vocabulary).collect()
    words = [r.word for r in best]
    marking = np.array([r.chi > 30 and r.t > 2 * r.n * t / n for r in best])
    number = {w.encode(): k for k, w in enumerate(words)}
    shared = docs.sparkSession.sparkContext.broadcast(number)

    @F.arrow_udf("array<struct<word:int,n:int>>")
    def counted(texts: pa.Array) -> pa.Array:
        out = [[{"word": w, "n": c} for w, c in sorted(_counts(raw, shared.value).items())] for raw in raw_rows(texts)]
        return pa.array(out, pa.list_(pa.struct([("word", pa.int32()), ("n", pa.int32())])))

    rows = sample.select("doc_id", F.col("__label").alias("y"), counted(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    found = rows.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("row")).orderBy("doc_id").select("row.*").toArrow()  # the same row in every run
    lists, y = found.column("x").combine_chunks(), found.column("y").to_numpy().astype(int)
    flat = lists.flatten()
    cols, values = flat.field("word").to_numpy(zero_copy_only=False).astype(int), flat.field("n").to_numpy(zero_copy_only=False).astype(float)
    at = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    if y.max(initial=0) <= 1:
        marks = np.bincount(at, values * marking[cols], len(y))
        toxic = y > 0
        edges = np.quantile(marks[toxic], np.linspace(0, 1, grades)[1:-1]) if toxic.any() else np.zeros(grades - 2)
        y = np.where(toxic, 1 + np.searchsorted(edges, marks, "left"), 0)
    return fit_ordinal(at, cols, np.log1p(values), np.minimum(y, grades - 1), words, grades)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with p_toxic = P(grade >= 1), severity (expected), grade (the likeliest) and toxic (p_toxic >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<p:double,severity:double,grade:int>")
    def graded(texts: pa.Array) -> pa.Array:
        own = shared.value
        number = {w.encode(): k for k, w in enumerate(own.words) if own.weights[k]}
        margins = np.array([sum(own.weights[w] * np.log1p(c) for w, c in _counts(raw, number).items()) for raw in raw_rows(texts)], float)
        p = own.grades(margins)
        each = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1), axis=1)
        return pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32))], names=["p", "severity", "grade"])

    found = docs.withColumn("__graded", graded(F.coalesce(F.col(text), F.lit(""))))
    named = {"p_toxic": F.col("__graded.p"), "severity": F.col("__graded.severity"), "grade": F.col("__graded.grade"), "toxic": F.col("__graded.p") >= 0.5}
    return found.withColumns(named).drop("__graded")
