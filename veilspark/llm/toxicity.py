"""Toxicity grades by cumulative-link (proportional odds) regression.

Features are the distinct words of a text. Labels say toxic or not; grades above
0 come from how many distinct words typical of toxic documents a toxic document
holds (1, 2 and 3 from one, two and four on). One weight vector serves all ordered
thresholds: P(grade <= k) = sigmoid(threshold_k - weights . words).

Grades are so a reading of the words, not of labels: what the labels teach is the step from 0 to 1, and
which words count; that more such words are worse is an assumption.

The model is fitted on at most `max_labelled` labelled rows, those with the
smallest hashed ids; that bound is a parameter. Scoring is one pass over all
texts with a weight table of at most `max_features` words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, map_arrow, put
from .textbytes import LOWER, NOT_WORD, U64, Words, blocks, buffer_of

GRADES = 4
FIRST_COUNT = (1, 2, 4)  # typical words from which a toxic document has grade 1, 2, 3


@dataclass
class Model:
    words: np.ndarray  # sorted word hashes
    weights: np.ndarray
    thresholds: np.ndarray  # of grades 1.. ; empty if there was nothing to learn from
    reject_from: float = 0.5  # expected severity


def _vocabulary(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(LOWER[raw], offsets, NOT_WORD)
    return words.hashes(), np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))


def _hits(batch: pa.RecordBatch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs of a block."""
    h, doc = _vocabulary(*buffer_of(batch.column("text")))
    if not len(words) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = words[at] == h
    key = np.unique(doc[hit] * len(words) + at[hit])
    return key // len(words), key % len(words)


def _counts(batches):
    for batch in blocks(batches, limit=4 << 20):
        h, doc = _vocabulary(*buffer_of(batch.column("text")))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        word, which = np.unique(h, return_inverse=True)
        bad = np.bincount(which, toxic[doc], len(word)).astype(np.int64)
        total = np.bincount(which, minlength=len(word))
        yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(bad), pa.array(total)], names=["word", "toxic", "docs"])


def _examples(words: np.ndarray):
    def run(batches):
        for batch in blocks(batches):
            doc, feature = _hits(batch, words)
            parts = np.split(feature.astype("<i4"), np.searchsorted(doc, np.arange(1, batch.num_rows)))
            yield pa.record_batch([batch.column("toxic"), pa.array([p.tobytes() for p in parts], pa.binary())], names=["toxic", "features"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Problem:
    """The mean negative log likelihood of grades, with its gradient. rows: (toxic, features); typical: which features are typical of toxic documents."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], typical: np.ndarray, l2: float):
        self.n, self.k, self.size, self.l2 = len(rows), GRADES - 1, len(typical), l2
        self.doc = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
        self.feature = np.concatenate([f for _, f in rows]) if rows else np.zeros(0, np.int64)
        toxic = np.array([t for t, _ in rows])
        found = np.bincount(self.doc, typical[self.feature], len(rows))
        self.y = np.where(toxic == 1, np.maximum(1, np.searchsorted(FIRST_COUNT, found, "right")), 0)

    def thresholds(self, params: np.ndarray) -> np.ndarray:
        """Ordered by their form: the first one, and the logs of the gaps."""
        return params[self.size] + np.concatenate(([0], np.cumsum(np.exp(params[self.size + 1 :]))))

    def loss(self, params: np.ndarray) -> tuple[float, np.ndarray]:
        n, k, y, rows = self.n, self.k, self.y, np.arange(self.n)
        w, gaps = params[: self.size], params[self.size + 1 :]
        s = np.bincount(self.doc, w[self.feature], n)
        cdf = np.column_stack([np.zeros(n), _sigmoid(self.thresholds(params) - s[:, None]), np.ones(n)])
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[rows, y + 1] - cdf[rows, y], 1e-12)
        up, low = slope[rows, y + 1] / p, slope[rows, y] / p
        ds = up - low  # of the loss -log p by s
        dtheta = np.array([-(up[y == j].sum()) + low[y == j + 1].sum() for j in range(k)])
        grad = np.concatenate([np.bincount(self.feature, ds[self.doc], self.size) + self.l2 * w * n / 1000, [dtheta.sum()], [dtheta[j:].sum() * np.exp(gaps[j - 1]) for j in range(1, k)]]) / n
        return float(-np.log(p).mean() + self.l2 * (w @ w) / 2000), grad


def train(rows: list[tuple[int, np.ndarray]], typical: np.ndarray, l2: float = 0.01, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch Adam."""
    problem = Problem(rows, typical, l2)
    params = np.zeros(len(typical) + GRADES - 1)  # weights, first threshold, log gaps
    params[len(typical)] = 2.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        grad = problem.loss(params)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return params[: len(typical)], problem.thresholds(params)


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(toxic, text) of at most `max_labelled` rows of `docs`: those of the smallest hashed ids, and of a repeated id the smallest hashed texts."""
    order = lambda *c: [F.xxhash64(*c), *c]
    sample = (
        labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(*order("_id")).limit(max_labelled)
    )
    known = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "toxic", "text", F.xxhash64("_id", F.sha2("text", 256)).alias("h"))
    return known.orderBy(F.xxhash64("_id"), "h").limit(max_labelled).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_features: int = 4096, least_docs: int = 4, least_z: float = 4.0) -> Model:
    """Fits a model on labelled documents. Rows without id, text or label teach nothing; an id with several labels is toxic if any says so."""
    known = put(labelled(docs, labels, max_labelled), "labelled")
    total, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    empty = Model(np.zeros(0, U64), np.zeros(0), np.zeros(0))
    if not bad or bad == total:
        drop(known)
        return empty
    a, n = F.col("a"), F.col("n")
    rate = bad / total
    z = (a - n * rate) / F.sqrt(n * rate * (1 - rate))
    chosen = (
        map_arrow(known, _counts, "word long, toxic long, docs long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("docs").alias("n"))
        .filter(n >= least_docs).withColumn("z", z).filter(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "word").limit(max_features).collect()
    )
    if not chosen:
        drop(known)
        return empty
    words = np.array([r["word"] for r in chosen], np.int64).view(U64)
    order = np.argsort(words)
    words, typical = words[order], np.array([r["z"] > 0 for r in chosen])[order]
    found = sorted((r["toxic"], bytes(r["features"])) for r in map_arrow(known, _examples(words), "toxic int, features binary").collect())  # one order, so one model
    rows = [(toxic, np.frombuffer(features, "<i4")) for toxic, features in found]
    drop(known)
    return Model(words, *train(rows, typical))


def grades(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_toxic, severity (the expected grade, 0 to 3), grade (the likeliest), toxic (severity from `model.reject_from` on).

    A row for each row of `docs`, repeated ones too; null ids stay null. Null and empty
    texts have no words and get the model's base rate. Without a learned model
    everything is 0. Other columns of `docs` are not read.
    """

    def run(batches):
        for batch in blocks(batches):
            n = batch.num_rows
            if len(model.thresholds):
                doc, feature = _hits(batch, model.words)
                s = np.bincount(doc, model.weights[feature], n)
                above = 1 - _sigmoid(model.thresholds - s[:, None])
            else:
                above = np.zeros((n, GRADES - 1))
            p = -np.diff(np.column_stack([np.ones(n), above, np.zeros(n)]), axis=1)
            severity = above.sum(axis=1)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(above[:, 0]), pa.array(severity), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(severity >= model.reject_from)],
                names=["doc_id", "p_toxic", "severity", "grade", "toxic"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, p_toxic double, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, whose severity is under the model's bound; one pass without a shuffle."""
    schema = docs.schema

    def run(batches):
        for batch in blocks(batches):
            keep = np.ones(batch.num_rows, bool)
            if len(model.thresholds):
                doc, feature = _hits(batch, model.words)
                s = np.bincount(doc, model.weights[feature], batch.num_rows)
                keep = (1 - _sigmoid(model.thresholds - s[:, None])).sum(axis=1) < model.reject_from
            yield batch.filter(pa.array(keep))

    return map_arrow(docs, run, schema)
