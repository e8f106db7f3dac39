"""Document quality by regularised quadratic discriminant analysis (operator 4).

Statistics of the whole text (shares of kinds of characters, word lengths, repetition of words
and lines) are transformed to be closer to normal. For each class of the labelled documents the
mean and covariance are summed in Spark over all training rows; covariances are shrunk towards
the pooled one and a multiple of the unit matrix. A document's score is the logistic of the
difference of the classes' log densities, from Mahalanobis distances by Cholesky factors that
are computed once. The amounts of shrinkage and the divisor of the difference (statistics are not
independent, so it is too sure of itself) are those of least log loss in a cross-validation inside
the training rows.

Defined cases: null and empty texts have all statistics of an empty text and get its score; a
document with several labels counts by their mean (from 0.5 on: 1), labels that are null or of
unknown documents not at all; a class with a single labelled
document has no covariance and counts as one without any; with no label of a class, every score is
the share of the other (0.5 without labels); repeated rows are scored each; texts of any length are scored whole; an empty
table gives no rows; further columns are ignored by ``quality_scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .split import held_out
from .workspace import discard, written

STATISTICS = ["length", "words", "upper", "digit", "space", "line", "stop", "symbol", "wide", "word_mean", "word_sd", "short_words", "new_words", "new_lines", "line_mean", "symbol_words", "top_word"]
TABLE = np.zeros((256, 8))
for _kind, _codes in enumerate([range(65, 91), range(48, 58), [32, 9, 11, 12, 13], [10], map(ord, ".,;:?'\""), map(ord, "!#$%&()*+-/<=>@[\\]^_`{|}~"), range(128, 256), range(97, 123)]):
    TABLE[list(_codes), _kind] = 1
SYMBOLS = frozenset(b"!#$%&()*+-/<=>@[\\]^_`{|}~")


def statistics_of(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of STATISTICS."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ TABLE / max(n, 1)
    words, lines = data.split(), data.split(b"\n")
    m = len(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    kinds = set(words)
    top = 0
    if m:
        _, counts = np.unique(np.fromiter(map(hash, words), np.int64, m), return_counts=True)
        top = int(counts.max())
    log = lambda x: float(np.log(x + 1e-3))
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        *[log(s) for s in shares[:7]],
        float(np.log1p(lengths.mean())) if m else 0.0,
        float(np.log1p(lengths.std())) if m else 0.0,
        log((lengths <= 3).mean()) if m else 0.0,
        len(kinds) / m ** 0.75 if m else 0.0,
        log(len(set(lines)) / len(lines)),
        float(np.log1p(n / len(lines))),
        log(sum(w[-1] in SYMBOLS for w in words) / m) if m else log(0),
        log(top / m) if m else 0.0,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every whole text."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics_of(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(describe, "doc_id long, stats array<double>")


#: What cross-validation chooses from: share of the pooled covariance, share of the unit matrix, divisor of the difference.
POOLS, RIDGES, TEMPERATURES = (0.2, 0.6, 0.9), (0.02, 0.1), (1.0, 2.0, 4.0)


class Discriminant:
    """Two classes' means and Cholesky factors of their shrunk covariances."""

    def __init__(self, moments: dict[int, np.ndarray], pool: float = POOLS[1], ridge: float = RIDGES[0], temperature: float = TEMPERATURES[1]):
        self.pool, self.ridge, self.temperature = pool, ridge, temperature
        self.share = 0.5
        self.classes = None
        d = len(STATISTICS)
        n = {c: m[0] for c, m in moments.items() if m[0] > 1}
        if n:
            self.share = n.get(1, 0) / sum(n.values())
        if len(n) < 2:
            return
        mean = {c: moments[c][1 : 1 + d] / n[c] for c in n}
        own = {c: moments[c][1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in n}
        pooled = sum(n[c] * own[c] for c in n) / sum(n.values())
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        unit = np.outer(self.scale, self.scale)
        self.classes = {}
        for c in (0, 1):
            s = ((1 - pool) * own[c] + pool * pooled) / unit
            s = (1 - ridge) * s + ridge * max(float(np.trace(s)) / len(s), 1e-3) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.classes[c] = (mean[c], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))

    def differences(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        density = {}
        for c, (mean, inverse, log_det) in self.classes.items():
            z = ((x - mean) / self.scale) @ inverse.T
            density[c] = -0.5 * (z * z).sum(axis=1) - log_det
        return density[1] - density[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        return self.logistic(self.differences(x), self.temperature)

    def logistic(self, difference: np.ndarray, temperature: float) -> np.ndarray:
        margin = difference / temperature + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _moments(rows: DataFrame, folds: int) -> np.ndarray:
    """Count, sums and sums of products by fold and class, over all rows (fold, label, stats); sums only reach the driver."""
    d = len(STATISTICS)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, 2, 1 + d + d * d))
        for frame in frames:
            for (fold, c), part in frame.groupby(["fold", "label"])["stats"]:
                x = np.stack(part.to_numpy())
                total[fold, c] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pd.DataFrame({"fold": np.repeat(np.arange(folds), 2), "label": [0, 1] * folds, "sums": [*total.reshape(2 * folds, -1)]})

    parts = rows.mapInPandas(sums, "fold int, label int, sums array<double>").select("fold", "label", F.posexplode("sums").alias("at", "x"))
    moments = np.zeros((folds, 2, 1 + d + d * d))
    for fold, c, at, x in parts.groupBy("fold", "label", "at").agg(F.sum("x")).collect():  # 2 folds (1 + d + d d) numbers
        moments[fold, c, at] = x
    return moments


def _losses(rows: DataFrame, moments: np.ndarray) -> np.ndarray:
    """Mean log loss of (pool, ridge, temperature), each fold scored by a model of the others."""
    shape = (len(POOLS), len(RIDGES), len(TEMPERATURES))
    models = [[[Discriminant(dict(enumerate(moments.sum(axis=0) - m)), pool, ridge) for ridge in RIDGES] for pool in POOLS] for m in moments]

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                x, y = np.stack(part["stats"].to_numpy()), part["label"].to_numpy()
                for i in range(shape[0]):
                    for j in range(shape[1]):
                        model = models[fold][i][j]
                        difference = model.differences(x) if model.classes else np.zeros(len(x))
                        for k, temperature in enumerate(TEMPERATURES):
                            p = np.clip(model.logistic(difference, temperature), 1e-6, 1 - 1e-6)
                            total[i, j, k] -= np.log(np.where(y == 1, p, 1 - p)).sum()
        yield pd.DataFrame({"choice": np.arange(total.size), "loss": total.ravel()})

    losses = np.zeros(shape)
    for choice, loss in rows.mapInPandas(measure, "choice int, loss double").groupBy("choice").agg(F.sum("loss")).collect():  # a number for each choice
        losses.flat[choice] = loss
    return losses / moments[:, :, 0].sum()


def fit(stats: DataFrame, labels: DataFrame, folds: int = 3) -> Discriminant:
    """A discriminant from the labelled rows of ``stats`` that are not held out, all of them."""
    label = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")
    rows = written(stats.where(~held_out()).join(label, "doc_id").select(fold.alias("fold"), "label", "stats"), "labelled")
    moments = _moments(rows, folds)
    whole = moments.sum(axis=0)
    choice = (POOLS[1], RIDGES[0], TEMPERATURES[1])
    if (moments.sum(axis=0)[:, 0] > folds).all():
        losses = np.round(_losses(rows, moments), 6)  # so that the order of sums decides nothing
        i, j, k = np.unravel_index(int(losses.argmin()), losses.shape)
        choice = (POOLS[i], RIDGES[j], TEMPERATURES[k])
    discard(rows)
    return Discriminant(dict(enumerate(whole)), *choice)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality)."""
    stats = written(statistics(docs), "statistics")
    model = fit(stats, labels)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.scores(np.stack(frame["stats"].to_numpy())) if len(frame) else []})

    scored = stats.mapInPandas(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label_rows: int = 20_000) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score reaches ``threshold``; no text is shuffled.

    The model is fitted on at most ``label_rows`` labelled rows (those of smallest id hash), so
    that their ids can be broadcast and their statistics cost no pass over all texts' statistics.
    """
    ids = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out()).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id", "left_semi")
    model = fit(written(statistics(known), "statistics"), labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics_of(t) for t in text])) if len(text) else [], dtype="float64")

    return docs.where(score(F.col("text").cast("string")) >= threshold)
