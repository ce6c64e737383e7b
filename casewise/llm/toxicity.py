"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and of words' beginnings is trained in numpy from confirmed
toxic texts (P) and unlabelled texts (U: any texts of the learning folds, so
that the prior holds there). With class prior q and logistic loss
l, the risk is q*E_P[l(g)] + max(0, E_U[l(-g)] - q*E_P[l(-g)]): the second
term estimates the risk on clean texts, and where it falls below zero, its
gradient is followed the other way, so that the classifier does not learn to
call all of U clean.

Fitting reads a bounded sample (``max_positive`` and ``max_unlabelled`` rows,
the least by a hash of the id, and ``vocabulary`` words); scoring covers every
whole text. Labels come from the learning folds alone.

Defined results: null and empty texts score by the intercept alone; without
confirmed toxic rows every score is the prior (0.0 where there is no label at
all); repeated rows score alike; a score equal to the
threshold (ties) is predicted 1; texts of any length are counted whole; a null label counts as unlabelled; an empty
table gives no rows; only doc_id and text are read from the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.llm.common import stored, table

EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\`~"


STEMS = (4, 5, 6, 7, 8)
#: Texts whose features are held at once.
ROWS = 100


def features_of(text: str | None, stems: tuple[int, ...] = STEMS) -> dict[str, float]:
    """log(1 + 200 x share of the text's words) for each word and, marked with a hyphen, each beginning of words.

    Words are lower case, without punctuation at their ends.
    """
    counts, total = Counter(), 0
    for raw, n in Counter((text or "").lower().split()).items():
        total += n
        if w := raw.strip(EDGES):
            counts[w] += n
            for k in stems:
                if len(w) > k:
                    counts[w[:k] + "-"] += n
    return {w: log1p(200 * n / total) for w, n in counts.items()}


def fold(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % 4


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    prior: float

    def scores(self, texts: list[str | None]) -> list[float]:
        w, known = self.weights, self.weights.keys()
        stems = tuple(sorted({len(x) - 1 for x in known if x.endswith("-")}))
        z = np.full(len(texts), self.bias)
        for k, t in enumerate(texts):
            f = features_of(t, stems)
            z[k] += sum(w[x] * f[x] for x in sorted(known & f.keys()))
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


Row = tuple[np.ndarray, np.ndarray]


def nn_pu(positive: list[Row], unlabelled: list[Row], size: int, prior: float, steps: int = 600, rate: float = 0.1, decay: float = 2e-5, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk by Adam; a row is the places and the values of its features."""
    rows = [r[0] for r in positive + unlabelled]
    x = np.concatenate([*(r[1] for r in positive + unlabelled), np.empty(0)])
    lens = np.asarray([len(r) for r in rows])
    at, idx = np.repeat(np.arange(len(rows)), lens), np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    p, u = len(positive), len(unlabelled)
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for k in range(1, steps + 1):
        g = np.bincount(at, theta[idx] * x, len(rows)) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        clean = np.logaddexp(0, g[p:]).mean() - prior * np.logaddexp(0, g[:p]).mean()
        d_clean = np.concatenate([-prior * s[:p] / p, s[p:] / u])
        d = np.concatenate([prior * (s[:p] - 1) / p, np.zeros(u)]) + d_clean if clean >= -beta else -d_clean
        grad = np.append(np.bincount(idx, d[at] * x, size), d.sum()) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    g, low, high = (np.bincount(at, theta[idx] * x, len(rows)))[p:], -40.0, 40.0
    for _ in range(60):  # the intercept at which the mean score of U is the prior
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(-np.clip(g + mid, -40, 40)))).mean() < prior else (low, mid)
    return theta[:-1], mid


def fit(documents: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = 6000, max_unlabelled: int = 14000, vocabulary: int = 1024, least_df: int = 5, least_z: float = 5.0, least_lift: float = 3.0) -> Model:
    """Learns from documents whose fold is not 2. The prior is a parameter; by default the share of toxic labels there."""
    y = labels.where(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = y.agg(F.count("toxic"), F.sum("toxic")).first()
    prior = prior if prior is not None else (toxic or 0) / n if n else 0.0
    texts = documents.select("doc_id", "text").where("doc_id is not null").where(fold(F.col("doc_id")) != 2)
    least = lambda ids, limit: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    ids = texts.select("doc_id").distinct().join(y, "doc_id", "left")
    chosen = least(ids.where("toxic = 1"), max_positive).select("doc_id", F.lit(1).alias("p")).union(least(ids, max_unlabelled).select("doc_id", F.lit(0)))
    if not toxic or not 0 < prior < 1:
        return Model({}, 40.0 if prior >= 1 else float(np.log(prior / (1 - prior))) if prior > 0 else -40.0, prior)

    sample = stored(texts.join(F.broadcast(chosen), "doc_id").select("p", "text"), "sample")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(features_of(t)) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["p", "words"])

    np_, nu = (sample.where(f"p = {k}").count() for k in (1, 0))
    if not np_ or not nu:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    counts = sample.mapInArrow(split, "p int, words array<string>").select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum("p").alias("a"), F.count("*").alias("n"))
    a, b = F.col("a") / np_, (F.col("n") - F.col("a")) / nu
    both = F.col("n") / (np_ + nu)
    z = F.abs(a - b) / F.sqrt(both * (1 - both) * (1 / np_ + 1 / nu) + 1e-12)
    top = [r.word for r in counts.where(f"n >= {least_df}").where(z >= least_z).where(a >= least_lift * b).orderBy(F.desc(z), "word").limit(vocabulary).collect()]
    place = {w: k for k, w in enumerate(sorted(top))}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            found = [sorted((place[w], v) for w, v in features_of(t).items() if w in place) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[v for _, v in f] for f in found], pa.list_(pa.float64()))], names=["p", "f", "v"])

    rows: pd.DataFrame = sample.mapInArrow(index, "p int, f array<int>, v array<double>").toPandas()  # max_positive + max_unlabelled rows at most
    both = sorted((p, tuple(f), tuple(v)) for p, f, v in zip(rows.p, rows.f, rows.v, strict=True))  # the same sums whatever order the tasks end in
    w, bias = nn_pu(*([(np.asarray(f, np.int64), np.asarray(v, float)) for p, f, v in both if p == k] for k in (1, 0)), len(place), prior)
    return Model({x: float(w[k]) for x, k in place.items() if w[k]}, bias, prior)


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.scores(b.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = documents.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels")))
