"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that training sees. The
non-negative risk estimator keeps the estimated risk on hidden negatives,
``risk(unlabelled as negative) - prior * risk(positives as negative)``, from
falling below zero; where it does, the step goes the other way. The share of
positives among all text, the class prior, is estimated from the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tightknit.llm.batches import bytes_of, crc_of_id, id_text, offsets_of, pieces, sums_by_row
from tightknit.llm.quality_rules import Texts, base_measures

#: Bounds of the training sample, in texts.
POSITIVES, UNLABELLED = 4_000, 8_000

#: Classes of bytes: blank, line feed, digit, lower case, upper case, beyond ASCII, then single signs.
SIGNS = b".,;:!?'\"-()[]{}|#*$%&<>/\\@_=+~^`"
CLASS = np.zeros(256, np.int64)
CLASS[[9, 10, 11, 12, 13, 32]] = [0, 1, 0, 0, 0, 0]
CLASS[48:58] = 2
CLASS[97:123] = 3
CLASS[65:91] = 4
CLASS[128:] = 5
CLASS[list(SIGNS)] = np.arange(6, 6 + len(SIGNS))
N_CLASSES = 6 + len(SIGNS)
GROUP = np.minimum(CLASS, 6)  # all signs together, for pairs of neighbors
N_FEATURES = N_CLASSES + 49 + 7


def features(column: pa.Array) -> np.ndarray:
    """Shares of byte classes and of pairs of them, of repeated words and lines, and shape figures, of every whole text."""
    data, offsets = bytes_of(column), offsets_of(column)
    n, lengths = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    size = np.maximum(lengths, 1)[:, None]
    single = np.bincount(row * N_CLASSES + CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    kind = GROUP[data]
    inner = np.ones(max(len(data) - 1, 0), bool)
    inner[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))] - 1] = False
    pair = row[:-1] * 49 + kind[:-1] * 7 + kind[1:] if len(data) else np.zeros(0, np.int64)
    double = np.bincount(pair[inner], minlength=n * 49).reshape(n, 49)
    blank = kind <= 1
    starts = ~blank
    starts[1:] &= blank[:-1]
    words = np.maximum(sums_by_row(starts.astype(np.int64), offsets), 1)
    known = base_measures(Texts(column))
    shape = np.column_stack(
        [np.log1p(lengths) / 10, np.log1p(words) / 10, lengths / words / 10, single[:, 1] / words,
         known["n_repeat_words"] / words, known["n_stutter_words"] / words, known["n_dup_lines"] / np.maximum(known["n_lines"], 1)]
    )
    return np.hstack([np.sqrt(single / size), np.sqrt(double / size), shape]).astype(np.float32)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(
    positive: np.ndarray,
    unlabelled: np.ndarray,
    prior: float,
    *,
    units: int = 16,
    epochs: int = 40,
    rate: float = 0.003,
    decay: float = 1e-3,
    seed: int = 3,
) -> QualityModel:
    """Minimise the non-negative risk with the logistic loss, by Adam over mixed batches."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    weights = [
        rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], units)),
        np.zeros(units),
        rng.normal(0, 1 / np.sqrt(units), units),
        np.zeros(1),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0

    def slopes(x: np.ndarray, label: int) -> tuple[float, list[np.ndarray]]:
        """Mean logistic loss of ``x`` taken as ``label`` (1 or -1), and its gradient."""
        h = np.tanh(x @ weights[0] + weights[1])
        margin = label * (h @ weights[2] + weights[3])
        loss = np.logaddexp(0, -margin).mean()
        d = -label / (1 + np.exp(np.clip(margin, -30, 30))) / len(x)
        dh = np.outer(d, weights[2]) * (1 - h * h)
        return loss, [x.T @ dh, dh.sum(axis=0), h.T @ d, np.array([d.sum()])]

    size = 256
    n_batches = max(1, len(u) // size)
    for _ in range(epochs):
        pu, pp = rng.permutation(len(u)), rng.permutation(len(p))
        for b in range(n_batches):
            xu, xp = u[pu[b::n_batches]], p[pp[b % len(p) :: n_batches]]
            if not len(xp):
                continue
            _, as_positive = slopes(xp, 1)
            risk_p, p_negative = slopes(xp, -1)
            risk_u, u_negative = slopes(xu, -1)
            if risk_u - prior * risk_p >= 0:
                move = [prior * a + c - prior * b_ for a, b_, c in zip(as_positive, p_negative, u_negative)]
            else:
                move = [prior * b_ - c for b_, c in zip(p_negative, u_negative)]
            step += 1
            for w, g, a, v in zip(weights, move, first, second):
                g = g + decay * w
                a += 0.1 * (g - a)
                v += 0.001 * (g * g - v)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]))


def _with_features(rows: DataFrame, keep: str) -> DataFrame:
    """Column ``keep`` and the features of every text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            x = features(piece.column(0))
            values = pa.array(x.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays(
                [piece.column(1), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES, values)],
                [keep, "x"],
            )

    return rows.mapInArrow(measure, f"{keep} boolean, x array<float>")


def train_on(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    *,
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    text: str = "text",
    doc_id: str = "doc_id",
) -> QualityModel | None:
    """Fit on bounded samples of trusted positives and of unlabelled texts.

    ``usable`` selects the documents whose labels may be learned from. Samples are
    the first ids by a hash of the id. The prior is the share of positives among
    all usable labels, less half a label of either class. Labels without a class are ignored; of
    contradictory labels of a document the larger counts. None without positives.
    """
    known = (
        labels.where(labels["quality"].isNotNull() & labels["doc_id"].isNotNull())
        .groupBy(labels["doc_id"].cast("bigint").alias("doc_id"))
        .agg(F.max("quality").alias("quality"))
        .where(usable)
    )
    n, n_good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not n_good:
        return None
    prior = (n_good + 0.5) / (n + 1)
    rows = id_text(docs, text=text, doc_id=doc_id).where(usable)
    by_hash = F.xxhash64("doc_id")
    trusted = known.where("quality = 1").select("doc_id").orderBy(by_hash, "doc_id").limit(positives)
    # Both id lists are bounded by parameters.
    others = rows.select("doc_id").orderBy(by_hash.desc(), "doc_id").limit(unlabelled).distinct()
    found = (
        rows.join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("p"))), "doc_id", "left")
        .join(F.broadcast(others.select("doc_id", F.lit(True).alias("u"))), "doc_id", "left")
        .where("p or u")
        .select("text", F.explode(F.filter(F.array(F.when(F.col("p"), True), F.when(F.col("u"), False)), lambda v: v.isNotNull())).alias("trusted"))
    )
    sample = _with_features(found, "trusted").toArrow()
    x = np.stack(sample.column(1).to_pylist()).astype(np.float64) if sample.num_rows else np.zeros((0, N_FEATURES))
    good = np.array(sample.column(0).to_pylist(), bool)
    if not good.any() or good.all():
        return None
    order = np.lexsort(x.T)  # the same model whatever the order of arrival
    x, good = x[order], good[order]
    return fit(x[good], x[~good], prior)


def score_quality(
    docs: DataFrame, model: QualityModel | None, *, threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Score of every whole text, empty and null ones too: ``doc_id, score, predicted``.

    One row per row of ``docs``; without a model every score is 0.5.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            score = model.score(features(piece.column(1))) if model else np.full(piece.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(score, pa.float64())], ["doc_id", "score"]
            )

    scored = id_text(docs, text=text, doc_id=doc_id).mapInArrow(predict, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(n: int, remainder: int, doc_id: str = "doc_id") -> Column:
    return crc_of_id(doc_id) % n == remainder
