"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade >= k) = sigmoid(w . x - theta_k): one weight vector for all ordered
thresholds. x marks which words of a learned list a text holds. The expected
severity is the sum over k of P(grade >= k).

The model is fitted on a bounded sample of labelled documents (``SAMPLE`` of each
label, chosen by a hash of the id; a parameter). Grade 0 is a document labelled
clean. Labels have one bit, so the labelled toxic ones are split into grades 1
and up at the quantiles of their share of marked words; the marks that grade one
half of the sample come from the other half, so no document is graded by words
that it helped to choose. The probability from which a document is rejected is
the one that errs least on folds of the sample that the model has not seen (the
list of words comes from the whole sample). Everything is then scored in one
pass over whole texts, without a shuffle.

Null texts are empty and score as a text without listed words. Very long texts
are scored whole. Documents without a label, null labels and labels without a
document are not fitted on; of several labels of an id the highest counts. With
no sample of both kinds every severity is 0 and nothing is rejected. Repeated
rows score alike, an empty table gives no rows. All columns, whatever their
names, are kept as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE = 4000
#: Sample documents that must hold a word before it can become a feature.
LEAST_DOCS = 5
#: Least likelihood ratio statistic of a word that becomes a feature. The sample bounds how many there are.
LEAST_G = 15.0
GRADES = 3
FOLDS = 3
#: P(grade >= 1) from which a document is rejected where the sample is too small to find it.
REJECT_FROM = 0.5
WORD = re.compile(r"[^\W\d_]+")
SCORED = "grade int, expected_severity double, p_toxic double, toxic boolean"


def tokens(text: str) -> set[str]:
    """The sparse features of a text: its words, and the first four and five letters of longer ones."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, is_toxic, text): at most ``sample`` different documents of each label; copies count once."""
    named = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("is_toxic"))
    some = [named.filter(F.col("is_toxic") == flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for flag in (True, False)]
    chosen = some[0].unionByName(some[1])  # at most 2 x sample ids
    texts = docs.select("doc_id", common.text_bytes().alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most the sample and its repeated ids
    return found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("is_toxic").alias("is_toxic")).groupBy("doc_id").agg(F.max("is_toxic").alias("is_toxic"), F.max("text").alias("text"))


def _sparse(sample: DataFrame) -> DataFrame:
    """(doc_id, is_toxic, n_words, word) of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sorted(tokens(t)) for t in common.strings(b.column(2))]
            rep = np.repeat(np.arange(b.num_rows), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rep)), b.column(1).take(pa.array(rep)), pa.array([w for s in sets for w in s], pa.string())], names=["doc_id", "is_toxic", "word"])

    return sample.select(F.col("doc_id").cast("long"), "is_toxic", "text").mapInArrow(run, "doc_id long, is_toxic boolean, word string")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def cuts_of(p: np.ndarray, n: int) -> np.ndarray:
    """The ordered thresholds in a parameter vector of ``n`` weights, a first threshold and the logs of gaps."""
    return p[n] + np.concatenate([[0], np.cumsum(np.exp(p[n + 1 :]))])


def loss(p: np.ndarray, at: np.ndarray, col: np.ndarray, grades: np.ndarray, share: np.ndarray, n: int, l2: float) -> tuple[float, np.ndarray]:
    """The mean negative log likelihood with its ridge, and its gradient. Row at[i] holds feature col[i]."""
    cuts = cuts_of(p, n)
    z = np.bincount(at, weights=p[:n][col], minlength=len(grades))
    above = sigmoid(z[:, None] - cuts[None, :])  # P(grade >= k)
    full = np.hstack([np.ones((len(z), 1)), above, np.zeros((len(z), 1))])
    i = np.arange(len(z))
    prob = np.maximum(full[i, grades] - full[i, grades + 1], 1e-12)
    slope = full * (1 - full)
    dz = -share * (slope[i, grades] - slope[i, grades + 1]) / prob
    d_cut = np.zeros_like(cuts)
    np.add.at(d_cut, grades[grades > 0] - 1, (share * slope[i, grades] / prob)[grades > 0])
    last = grades < len(cuts)
    np.add.at(d_cut, grades[last], -(share * slope[i, grades + 1] / prob)[last])
    g = np.zeros_like(p)
    g[:n] = np.bincount(col, weights=dz[at], minlength=n) + l2 * p[:n] / len(grades)
    g[n] = d_cut.sum()
    g[n + 1 :] = np.cumsum(d_cut[::-1])[::-1][1:] * np.exp(p[n + 1 :])
    return float(-(share * np.log(prob)).sum() + 0.5 * l2 * (p[:n] ** 2).sum() / len(grades)), g


def best_threshold(p: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which rejecting errs least, by weight; the middle one of those that do equally well."""
    order = np.argsort(-p, kind="stable")
    kept = np.append((weight * toxic).sum(), (weight * toxic).sum() - np.cumsum((weight * toxic)[order]))  # toxic ones kept if so many are rejected
    lost = np.append(0.0, np.cumsum((weight * ~toxic)[order]))
    edges = np.concatenate([[1.0], p[order], [0.0]])
    wrong = np.where(edges[:-1] > edges[1:], kept + lost, np.inf)  # equal ones go together
    best = np.flatnonzero(wrong <= wrong.min() * (1 + 1e-12) + 1e-12)
    k = best[len(best) // 2]
    return float((edges[k] + edges[k + 1]) / 2)


class Ordinal:
    """Cumulative-link model over rows given as lists of feature numbers."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, row_weight: np.ndarray, l2: float = 0.5, steps: int = 400, rate: float = 0.1) -> Ordinal:
        """Adam on the full sample; thresholds stay ordered, being a first one plus positive gaps."""
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.concatenate(rows).astype(int) if len(at) else np.zeros(0, int)
        share = row_weight / row_weight.sum()
        high = np.cumsum([share[grades == k].sum() for k in range(n_grades)][::-1])[::-1][1:]
        theta = -np.log(np.maximum(high, 1e-6) / np.maximum(1 - high, 1e-6))
        p = np.concatenate([np.zeros(n_features), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-2))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            _, g = loss(p, at, col, grades, share, n_features, l2)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        return cls(p[:n_features], cuts_of(p, n_features))

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of linear scores."""
        return sigmoid(np.asarray(z)[:, None] - self.thresholds[None, :])


class Grader:
    """The word list and the fitted model; small enough to ship to every task."""

    def __init__(self, words: list[str], model: Ordinal | None, reject_from: float = REJECT_FROM):
        self.index, self.model, self.reject_from = {w: k for k, w in enumerate(words)}, model, reject_from

    def score(self, texts: list[str]) -> list[tuple[int, float, float, bool]]:
        if self.model is None or not texts:
            return [(0, 0.0, 0.0, False)] * len(texts)
        w, index = self.model.weights, self.index
        z = [math.fsum(w[index[t]] for t in tokens(x) & index.keys()) for x in texts]
        above = self.model.at_least(np.array(z))
        shares = np.hstack([np.ones((len(z), 1)), above]) - np.hstack([above, np.zeros((len(z), 1))])
        return [(int(g), float(s), float(p), bool(p >= self.reject_from)) for g, s, p in zip(shares.argmax(1), above.sum(1), above[:, 0], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = GRADES, reject_from: float | None = None, folds: int = FOLDS) -> Grader:
    """The grader of a sample; what reaches the driver is bounded by the sample."""
    half = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)) == 0
    chosen = common.cut(labelled_sample(docs, labels, sample).withColumn("half", half))
    n = {(r["is_toxic"], r["half"]): r["count"] for r in chosen.groupBy("is_toxic", "half").count().collect()}
    n1, n0 = (sum(v for (flag, _), v in n.items() if flag == wanted) for wanted in (True, False))
    if not n1 or not n0:
        return Grader([], None)
    parts = common.cut(_sparse(chosen).withColumn("half", half))
    counts = [F.count_if((F.col("is_toxic") == flag) & (F.col("half") == side)).alias(f"{'toxic' if flag else 'clean'}{int(side)}") for flag in (True, False) for side in (True, False)]
    by_word = parts.groupBy("word").agg(*counts).withColumn("a", F.col("toxic0") + F.col("toxic1")).withColumn("b", F.col("clean0") + F.col("clean1"))
    by_word = by_word.filter(F.col("a") + F.col("b") >= min(LEAST_DOCS, n1 + n0))
    share = (F.col("a") + F.col("b")) / F.lit(n1 + n0)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = part(F.col("a"), share * n1) + part(F.col("b"), share * n0) + part(n1 - F.col("a"), (1 - share) * n1) + part(n0 - F.col("b"), (1 - share) * n0)
    top = by_word.withColumn("g", 2 * ratio).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "word").collect()
    words = [r["word"] for r in top]
    index = {w: k for k, w in enumerate(words)}
    marks = {side: {index[r["word"]] for r in top if r[f"toxic{int(side)}"] / max(1, n.get((True, side), 0)) > 4 * r[f"clean{int(side)}"] / max(1, n.get((False, side), 0))} for side in (True, False)}
    listed = docs.sparkSession.createDataFrame([(w, k) for w, k in index.items()], "word string, k int")
    held = parts.join(F.broadcast(listed), "word").select("doc_id", "k").toArrow()
    ids = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "is_toxic", "half", F.octet_length("text").alias("size")).orderBy("doc_id").toArrow()
    doc, toxic, side, size = ids.column("doc_id").to_numpy(), np.array(ids.column("is_toxic").to_pylist()), ids.column("half").to_pylist(), ids.column("size").to_numpy()
    row = np.searchsorted(doc, held.column("doc_id").to_numpy())
    order = np.lexsort((held.column("k").to_numpy(), row))
    cols = np.split(held.column("k").to_numpy()[order], np.searchsorted(row[order], np.arange(1, len(doc))))
    heat = np.array([sum(int(k) in marks[not h] for k in c) for c, h in zip(cols, side, strict=True)]) / np.sqrt(size + 100.0)
    grade = np.where(toxic, 1, 0)
    for q in range(1, grades - 1):
        grade[toxic & (heat > np.quantile(heat[toxic], q / (grades - 1)))] = q + 1
    total = {bool(r["t"]): r["n"] for r in labels.filter("toxic is not null").groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    weight = np.where(toxic, total.get(True, n1) / n1, total.get(False, n0) / n0)

    def fitted(on: np.ndarray) -> Ordinal:
        return Ordinal.fit([c for c, keep in zip(cols, on, strict=True) if keep], grade[on], len(words), grades, weight[on])

    if reject_from is None:
        fold, p = np.zeros(len(doc), int), np.zeros(len(doc))
        for flag in (True, False):  # each fold has its share of both
            fold[toxic == flag] = np.arange((toxic == flag).sum()) % folds
        for k in range(folds) if min(n1, n0) >= folds else ():
            model = fitted(fold != k)
            p[fold == k] = model.at_least(np.array([model.weights[c].sum() for c, f in zip(cols, fold, strict=True) if f == k]))[:, 0]
        reject_from = best_threshold(p, toxic, weight) if min(n1, n0) >= folds else REJECT_FROM
    return Grader(words, fitted(np.ones(len(doc), bool)), reject_from)


def grade(docs: DataFrame, grader: Grader) -> DataFrame:
    """(row, grade, expected_severity, p_toxic, toxic): each document, as a struct, and its severity."""
    shipped = docs.sparkSession.sparkContext.broadcast(grader)

    def judge(texts: pa.Array) -> list[pa.Array]:
        rows = shipped.value.score(common.strings(texts))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return [pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]

    return common.judged(docs, judge, SCORED)


def accepted(docs: DataFrame, grader: Grader) -> DataFrame:
    """docs without those that the model rejects."""
    return grade(docs, grader).filter("not toxic").select("row.*")
