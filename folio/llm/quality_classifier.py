"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are learning rows labelled 1; labels of 0 are never read. The unlabelled texts are a sample of the
documents, whatever their labels. The class prior is estimated from those two alone: on halves that a first model has
not seen, the least ratio, over all score thresholds, of the unlabelled and of the positive share that scores as high
bounds the prior from above, and is met where only positives score so high; a margin for the sample's size is added to
each share. A linear model over shape features then minimises prior * R+(P) + max(0, R-(U) - prior * R-(P)) for the
logistic loss; where the second term turns negative, its gradient is reversed, so the model can't profit from fitting it.

Features say how a whole text looks, not which document it is: the distribution of its bytes, how often words
repeat, their length and the text's length. The model is fitted in one task from ``MAX_ROWS`` positive and as many
unlabelled texts at most, one for each id, chosen by a hash of their ids; only its weights come to the driver.
Scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import drop_held, text_bytes

MAX_ROWS = 4_000
STEPS, RATE, L2 = 400, 0.5, 1e-4
EXTRA = 5


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def features(raw: bytes) -> np.ndarray:
    """Square roots of byte shares, then share of words equal to the word before, distinct words by length, mean word length, log length."""
    out = np.zeros(256 + EXTRA)
    if raw:
        out[:256] = np.sqrt(np.bincount(np.frombuffer(raw, dtype="u1"), minlength=256) / len(raw))
    words = raw.split()
    n = len(words)
    if n:
        distinct = len(set(words))
        out[256] = sum(map(eq, words, words[1:])) / n
        out[257] = np.log1p(distinct) / np.log1p(n)
        out[258] = min(sum(map(len, words)) / n, 40) / 10
        out[259] = distinct / n
    out[260] = np.log1p(n) / 10
    return out


@dataclass(frozen=True)
class PuModel:
    """Score of features x: sigmoid of ((x - mean) * scale) . weights + bias."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, l2: float = L2) -> PuModel:
    """Minimises the non-negative risk by full gradient steps from zero: no chance is involved."""
    x = np.concatenate([positive, unlabelled])
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    scale = np.where(deviation > 1e-4, 1 / np.maximum(deviation, 1e-4), 0.0)
    p, z = (np.clip((a - mean) * scale, -8, 8) for a in (positive, unlabelled))
    w, b = np.zeros(x.shape[1]), 0.0
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
    moment, speed, moment_b, speed_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        gp, gu = p @ w + b, z @ w + b
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_positive = -prior * sigmoid(-gp) / len(p)  # of R+ by g
        d_unlabelled, d_taken = sigmoid(gu) / len(z), -prior * sigmoid(gp) / len(p)
        if negative_risk >= 0:
            grad, grad_b = p.T @ (d_positive + d_taken) + z.T @ d_unlabelled, (d_positive + d_taken).sum() + d_unlabelled.sum()
        else:
            grad, grad_b = -(p.T @ d_taken + z.T @ d_unlabelled), -(d_taken.sum() + d_unlabelled.sum())
        grad = grad + l2 * w
        moment, speed = 0.9 * moment + 0.1 * grad, 0.99 * speed + 0.01 * grad**2
        moment_b, speed_b = 0.9 * moment_b + 0.1 * grad_b, 0.99 * speed_b + 0.01 * grad_b**2
        step = 0.1 * rate / (1 + t / 100)
        w = w - step * (moment / (1 - 0.9**t)) / (np.sqrt(speed / (1 - 0.99**t)) + 1e-8)
        b = b - step * (moment_b / (1 - 0.9**t)) / (np.sqrt(speed_b / (1 - 0.99**t)) + 1e-8)
    return PuModel(mean, scale, w, float(b), prior)


def prior_bound(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio, over thresholds, of the shares of unlabelled and positive scores that reach it, each share of n with a margin of sqrt(log(20) / 2n)."""
    cuts = np.unique(positive)
    share = lambda a: 1 - np.searchsorted(np.sort(a), cuts, "left") / len(a)
    margin = lambda a: np.sqrt(np.log(20) / (2 * len(a)))
    have = share(positive)
    ratio = (share(unlabelled) + margin(unlabelled) + margin(positive)) / np.maximum(have, 1e-9)
    best = int(np.argmin(np.where(have > 0, ratio, np.inf)))
    return float(np.clip(share(unlabelled)[best] / have[best], 0.02, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The mean bound of two halves, each scored by a model of the other half; 0.5 where a half would be empty. Halves are dealt in an order of a fixed seed."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    positive, unlabelled = (a[np.random.default_rng(0).permutation(len(a))] for a in (positive, unlabelled))
    halves = [(positive[k::2], unlabelled[k::2]) for k in (0, 1)]
    found = []
    for (p, u), (p2, u2) in (halves, halves[::-1]):
        model = fit(p, u, 0.5)
        found.append(prior_bound(model.score(p2), model.score(u2)))
    return sum(found) / 2


def _sample(rows: DataFrame, seed: int, size: int, total: int) -> DataFrame:
    """About ``size`` ids by their hashes, ``size`` at most: a threshold leaves few, of which the smallest hashes are taken."""
    h = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    some = rows if total <= size else rows.where(h < int((1 << 40) * min(1.0, 1.2 * size / total)))
    return some.select("id").distinct().orderBy(h, "id").limit(size)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> PuModel | None:
    """The model, or None without any positive learning row or any document to learn from.

    Null ids and labels are left out, and so are held-out rows, as positives and as unlabelled texts. Of an id with
    several texts the least one counts; an id labelled both ways counts as positive.
    """
    known = labels.where(F.col(id_col).isNotNull() & (F.col(label_col) == 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"))
    given = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    n_known, n_given = known.count(), given.count()
    if not n_known or not n_given:
        return None
    chosen = _sample(known, 1, max_rows, n_known).withColumn("y", F.lit(1)).unionByName(_sample(given.select("id"), 2, max_rows, n_given).withColumn("y", F.lit(0)))
    rows = given.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("raw").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            for (ids, texts), ys in zip(text_bytes([batch], "id", "raw", batch.num_rows), [batch.column("y")], strict=False):
                yield pa.RecordBatch.from_arrays([ids, ys, pa.array([features(t).astype("f4") for t in texts], pa.list_(pa.float32()))], names=["id", "y", "x"])

    def fitted(got: pa.Table) -> pa.Table:
        drop_held()
        got = got.sort_by([("id", "ascending"), ("y", "ascending")])
        y = got["y"].to_numpy()
        models = []
        if (y == 1).any() and (y == 0).any():
            x = np.stack(got["x"].to_numpy()).astype("f8")
            positive, unlabelled = x[y == 1], x[y == 0]
            models.append(fit(positive, unlabelled, estimate_prior(positive, unlabelled)))
        vectors = [pa.array([getattr(m, c) for m in models], pa.list_(pa.float64())) for c in ("mean", "scale", "weights")]
        return pa.table([*vectors, *(pa.array([getattr(m, c) for m in models], pa.float64()) for c in ("bias", "prior"))], names=["mean", "scale", "weights", "bias", "prior"])

    of_texts = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, y int, x array<float>")
    model = of_texts.groupBy().applyInArrow(fitted, "mean array<double>, scale array<double>, weights array<double>, bias double, prior double").first()
    return model and PuModel(*(np.array(model[c]) for c in ("mean", "scale", "weights")), model.bias, model.prior)


def score(docs: DataFrame, model: PuModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, score (0.5 without a model), predicted (1 from 0.5 on).

    Null texts are scored as empty ones. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_bytes(batches, "id", "raw"):
            s = model.score(np.stack([features(t) for t in texts])) if model and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([ids, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype("i4"), pa.int32())], names=["id", "score", "predicted"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return given.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: PuModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the model rejects; columns and their order stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                x = np.stack([features(b"" if t is None else t) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(x) >= 0.5))

    if not model:
        return docs
    # texts go as bytes, so that those that are no UTF-8 pass, too
    raw = docs.withColumn(text_col, F.col(text_col).cast("binary"))
    return raw.mapInArrow(run, raw.schema).withColumn(text_col, F.col(text_col).cast(docs.schema[text_col].dataType))
