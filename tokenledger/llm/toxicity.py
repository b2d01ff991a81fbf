"""Toxicity by a factorization machine over hashed terms.

Terms are whole words and word stems of 4 and 5 bytes, so that inflected forms share a term.
score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if term i is in the text. The pairs catch what
a sum of single weights misses, such as an insult beside the mention of a group.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_LETTERS, int_lists, slices, word_hashes, written
from .langid import held_out

BITS, TERMS, FACTORS = 20, 512, 6


def hashed_terms(text: str | None) -> np.ndarray:
    """The distinct terms of the whole text, words and stems with A-Z lower-cased, hashed to BITS bits."""
    return np.unique((word_hashes((text or "").encode("utf-8", "surrogatepass").lower(), NOT_LETTERS, (4, 5)) >> np.uint64(64 - BITS)).astype(np.int32))


class FactorizationMachine:
    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.place = np.full(1 << BITS, -1, np.int16)
        self.place[terms] = np.arange(len(terms))
        self.bias, self.weights, self.factors = bias, weights, factors

    @classmethod
    def fit(cls, rows: list[np.ndarray], toxic: np.ndarray, share: float, kept: np.ndarray, steps: int = 200, decay: float = 1e-3, rate: float = 0.1) -> FactorizationMachine:
        """rows: the terms of each labelled text that are in kept, the sorted terms of the model. share: of toxic rows among
        all labelled ones, which sets the bias."""
        self = cls(kept, 0.0, np.zeros(len(kept)), np.random.default_rng(5).normal(0, 0.05, (len(kept), FACTORS)))
        x = np.zeros((len(rows), len(kept)), np.float32)
        for i, row in enumerate(rows):
            x[i, self._active(row)] = 1
        y = toxic.astype(np.float64)
        params = [np.zeros(1), self.weights, self.factors]
        slow, fast = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            self.bias = float(params[0][0])
            sums = x @ self.factors
            error = (1 / (1 + np.exp(-np.clip(self._margin(x, sums), -50, 50))) - y) / max(1, len(y))
            xe = x.T @ error
            grads = [np.array([error.sum()]), xe + 1e-6 * self.weights, x.T @ (error[:, None] * sums) - self.factors * xe[:, None] + decay * self.factors]
            for p, g, m, v in zip(params, grads, slow, fast, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        drawn = float(y.mean()) if len(y) else 0.5
        odds = lambda p: np.log(max(p, 1e-4) / max(1 - p, 1e-4))
        self.bias = float(params[0][0] + odds(share) - odds(drawn))
        return self

    def _active(self, row: np.ndarray) -> np.ndarray:
        at = self.place[row]
        return at[at >= 0]

    def _margin(self, x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.weights + 0.5 * ((sums**2).sum(axis=1) - x @ (self.factors**2).sum(axis=1))

    def score(self, row: np.ndarray) -> float:
        at = self._active(row)
        v = self.factors[at]
        margin = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def telling_terms(sample: DataFrame, terms: int = TERMS) -> np.ndarray:
    """The `terms` terms of sample (toxic, terms) whose shares in the two classes differ most by a test of two proportions,
    sorted; counted in Spark, so that only these come to the driver."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = (F.lit(float(max(1, n.get(k, 0)))) for k in (0, 1))
    seen = sample.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("toxic") == 0).alias("a"), F.count_if(F.col("toxic") == 1).alias("b"))
    mean = (F.col("a") + F.col("b")) / (n0 + n1)
    score = F.abs(F.col("b") / n1 - F.col("a") / n0) / F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.0)) * (1 / n0 + 1 / n1) + 1e-6)
    best = seen.select("term", score.alias("score")).where("score > 2").orderBy(F.desc("score"), "term").limit(terms)
    return np.sort(np.array([r["term"] for r in best.collect()], np.int32))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> FactorizationMachine:
    """Learns from at most per_class labelled documents of each class, those with the least hashed doc_id, outside the
    held-out fifth. The classes' shares are counted over all labelled rows. Labels that are null are left out.

    The driver gets these documents as lists of the model's terms, so TERMS numbers a document at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for k in (0, 1):
        part = known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # bound: 2 * per_class rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), int_lists([hashed_terms(x) for x in batch.column(2).to_pylist()], np.int32)], names=["doc_id", "toxic", "terms"])

    sample = written(sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, terms array<int>"), "labelled-terms")
    kept = telling_terms(sample)
    known_terms = F.array_intersect("terms", F.from_json(F.lit(json.dumps(kept.tolist())), "array<int>"))
    rows = sample.select("doc_id", "toxic", F.array_sort(known_terms).alias("terms")).toArrow().sort_by("doc_id")
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return FactorizationMachine.fit([x.values.to_numpy() for x in rows["terms"]], rows["toxic"].to_numpy().astype(np.int64), share, kept)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every document, from its whole text alone.

    Null and empty texts get the model's score for no terms. Repeated rows get equal results. An empty table gives no
    rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [shared.value.score(hashed_terms(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
