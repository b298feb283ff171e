"""Quality scores that join a document classifier with what is known of its site.

A logistic classifier over the shape of a text, fitted on a bounded sample of labelled rows, gives
each document a probability. Hosts and the paths below them get posteriors by hierarchical empirical
Bayes: sums of these probabilities, shrunk towards the host's and the global mean by strengths that
are themselves estimated from the spread of the sites. A document's final odds are the classifier's,
moved from the global prior to that of its path, without its own share in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.llm.common import stored

FIT_ROWS = 10_000
CUTS = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998)  # quantiles that part a feature
EDGE = 1e-6  # probabilities stay this far from 0 and 1

_SETS = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "white": (9, 10, 11, 12, 13, 32),
    "stop": tuple(b".,;:"),
    "loud": tuple(b"!?"),
    "bar": tuple(b"|"),
    "sign": tuple(b"#$%&*+-/<=>@\\^_`~"),
    "quote": tuple(b"\"'()[]{}"),
    "wide": range(128, 256),
}
_CLASS = np.zeros((256, len(_SETS)))
for _n, _codes in enumerate(_SETS.values()):
    _CLASS[list(_codes), _n] = 1


def shape(text: str) -> list[float]:
    """Features of a whole text: its length, shares of characters by kind, and how far words and lines repeat."""
    codes = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), "u1"), minlength=256)
    kinds = codes @ _CLASS / max(1, codes.sum())
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    again = sum(map(eq, words, words[1:]))
    marked = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,;:?!\"')"))
    return [*kinds, np.log1p(len(words)), len(set(words)) / n, again / n, marked / n, len(set(lines)) / m, n / m, sum(map(len, words)) / n, sum(map(str.isupper, words)) / n, sum(map(str.isalpha, words)) / n, float(len(words) / n)]


@dataclass(frozen=True)
class Classifier:
    """Additive logistic model: a weight for each bin of each feature."""

    bias: float
    edges: list[np.ndarray]
    weights: list[np.ndarray]

    def probabilities(self, shapes: np.ndarray) -> np.ndarray:
        raw = np.full(len(shapes), self.bias)
        for n, (edges, weights) in enumerate(zip(self.edges, self.weights)):
            raw += weights[np.searchsorted(edges, shapes[:, n], side="right")]
        return np.clip(1 / (1 + np.exp(-np.clip(raw, -30, 30))), EDGE, 1 - EDGE)


def fit(shapes: np.ndarray, labels: np.ndarray, ridge: float = 2.0, rounds: int = 25) -> Classifier:
    """Fits the bins' weights by Newton steps. Without rows, or with one label, all texts get the smoothed rate of label 1."""
    y = np.asarray(labels, float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y)) < 2:
        return Classifier(float(np.log(rate / (1 - rate))), [], [])
    edges = [np.unique(np.quantile(column, CUTS)) for column in shapes.T]
    sizes = [len(e) + 1 for e in edges]
    starts = np.cumsum([1, *sizes])
    x = np.zeros((len(y), starts[-1]))
    x[:, 0] = 1
    for n, column in enumerate(shapes.T):
        x[np.arange(len(y)), starts[n] + np.searchsorted(edges[n], column, side="right")] = 1
    weights, hold = np.zeros(starts[-1]), np.full(starts[-1], ridge)
    hold[0] = 1e-9
    weights[0] = np.log(rate / (1 - rate))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + hold * weights * (np.arange(len(weights)) > 0)
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(hold), slope)
        weights = weights - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(float(weights[0]), edges, [weights[a : a + k] for a, k in zip(starts, sizes)])


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_shape(texts: pa.Array) -> pa.Array:
    return pa.array([shape(text.as_py() or "") for text in texts], pa.list_(pa.float64()))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Classifier:
    """Fits the classifier on labelled rows: on all of them, or on `rows` drawn by a hash of the key.

    Rows without key or label don't count; a key labelled more than once takes its smallest label.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("__label"))
    drawn = known.orderBy(F.xxhash64("__key"), "__key").limit(rows)
    texts = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(drawn), "__key")
    found = texts.select(text_shape("__text").alias("shape"), "__label").orderBy(F.xxhash64("shape"), "__label").limit(rows).toArrow()
    return fit(np.array(found["shape"].to_pylist(), float).reshape(found.num_rows, len(shape(""))), found["__label"].to_numpy())


@dataclass(frozen=True)
class Prior:
    """Global mean, and the weight in documents of the global mean for hosts and of the host's for paths."""

    mean: float
    hosts: float
    paths: float


MOST = 1e9  # weight where sites don't differ beyond chance
LEAST = 1e-6  # weight where documents of a site don't differ: one alone still has the mean above it


def estimate(sites: DataFrame) -> Prior:
    """Prior by the method of moments from __host, __path, __n, __sum and __squares of all paths.

    The weight is the variance of documents within a path over that between sites, which is what
    the sites' means spread beyond what their size explains.
    """
    hosts = sites.groupBy("__host").agg(F.sum("__n").alias("n"), F.sum("__sum").alias("s"), F.count("*").alias("paths"), F.sum(F.col("__sum") * F.col("__sum") / F.col("__n")).alias("fit"), F.sum("__squares").alias("squares"), F.sum(F.col("__n") * F.col("__n")).alias("nn"))
    row = hosts.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("squares").alias("squares"), F.sum("fit").alias("path_fit"), F.sum("paths").alias("paths"),
        F.count("*").alias("hosts"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("host_fit"), F.sum(F.col("n") * F.col("n")).alias("host_nn"), F.sum(F.col("nn") / F.col("n")).alias("path_nn"),
    ).first()
    if not row["n"]:
        return Prior(0.5, MOST, MOST)
    mean, within = row["s"] / row["n"], max(0.0, row["squares"] - row["path_fit"]) / max(1, row["n"] - row["paths"])

    def weight(spread: float, groups: float, room: float) -> float:
        between = (spread - groups * within) / room if groups > 0 and room > 0 else 0.0
        return max(LEAST, min(MOST, within / between)) if between > 0 else MOST

    hosts_weight = weight(row["host_fit"] - row["s"] ** 2 / row["n"], row["hosts"] - 1, row["n"] - row["host_nn"] / row["n"])
    return Prior(float(mean), hosts_weight, weight(row["path_fit"] - row["host_fit"], row["paths"] - row["hosts"], row["n"] - row["path_nn"]))


def _logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(held / (1 - held))


def score_quality(documents: DataFrame, classifier: Classifier, host: Column, path: Column, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds doc_score, host_score, path_score, score and keep to every row.

    doc_score is the classifier's probability, host_score and path_score the posteriors of the
    document's site without the document itself, score the joint probability, keep whether it
    reaches the threshold. Null texts are empty; null hosts and paths are sites of their own;
    repeated rows count each. Columns of these names are replaced, others stay; an empty table
    stays empty. Texts are read twice, for the sites and for the scores, rather than shuffled:
    the sites are stored, and joined by broadcast only where the stored table is small.
    """
    shared = documents.sparkSession.sparkContext.broadcast(classifier)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            shapes = np.array([shape(t.as_py() or "") for t in texts], float).reshape(len(texts), len(shape("")))
            yield pa.array(shared.value.probabilities(shapes), pa.float64())

    placed = documents.withColumns({"doc_score": probability(F.col(text)), "__host": F.coalesce(host.cast("string"), F.lit("")), "__path": F.coalesce(path.cast("string"), F.lit(""))})
    p, rows = F.col("doc_score"), documents.count()
    sites = stored(placed.groupBy("__host", "__path").agg(F.count("*").alias("__n"), F.sum(p).alias("__sum"), F.sum(p * p).alias("__squares")), "sites", rows)
    prior = estimate(sites)
    hosts = sites.groupBy("__host").agg(F.sum("__n").alias("__host_n"), F.sum("__sum").alias("__host_sum"))
    known = stored(sites.join(hosts, "__host").drop("__squares"), "posteriors", rows)
    joined = placed.join(known, ["__host", "__path"])
    of_host = (F.col("__host_sum") - p + prior.hosts * prior.mean) / (F.col("__host_n") - 1 + prior.hosts)
    of_path = (F.col("__sum") - p + prior.paths * F.col("host_score")) / (F.col("__n") - 1 + prior.paths)
    odds = _logit(p) + _logit(F.col("path_score")) - _logit(F.lit(prior.mean))
    scored = joined.withColumn("host_score", of_host).withColumn("path_score", of_path).withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("keep", F.col("score") >= threshold).drop("__host", "__path", "__n", "__sum", "__host_n", "__host_sum")
