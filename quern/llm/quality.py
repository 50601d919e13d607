"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import matrix, settle, small_batches, summed

UPPER, LOWER, DIGIT = range(65, 91), range(97, 123), range(48, 58)
STATISTICS = 20
LEVELS = 1024


def statistics(text: str | None) -> np.ndarray:
    """Fixed-length description of a whole text; zeros for null or empty."""
    out = np.zeros(STATISTICS)
    if not text:
        return out
    raw = text.encode()
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = count / n
    words = text.split()
    lines = text.split("\n")
    used = share[share > 0]
    upper, lower = share[65:91].sum(), share[97:123].sum()
    out[:11] = (
        np.log1p(n),
        upper / (upper + lower + 1e-9),
        lower + upper + share[128:].sum(),
        share[48:58].sum(),
        share[9:14].sum() + share[32],
        share[33] + share[63],
        share[44] + share[46],
        share[[35, 36, 37, 38, 42, 64, 94, 126]].sum(),
        share[[124, 60, 62, 123, 125, 91, 93, 92, 95, 47, 61]].sum(),
        -(used * np.log2(used)).sum() / 8,
        len(set(lines)) / len(lines),
    )
    out[11] = np.log1p(n / len(lines))
    if words:
        many = Counter(words)
        m = len(words)
        pairs = set(zip(words, words[1:]))
        out[12:] = (
            np.log1p(m),
            len(many) / m,
            max(many.values()) / m,
            sum(map(str.__eq__, words, words[1:])) / m,
            len(pairs) / max(1, m - 1),
            np.log1p(n / m),
            sum(w[-1] in ".!?;:" for w in words) / m,
            np.log1p(max(map(len, many))),
        )
    return out


@dataclass
class Model:
    """score(x) = isotonic(ridge(features of x)); constant if only one label was seen."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(z), 1)), z / np.sqrt(z.shape[1]), waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.values)
        # a slight slope keeps the order of raw scores inside flat stretches
        return np.clip(0.998 * level + 0.002 * np.clip(raw, 0, 1), 0, 1)


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators of mean y over bins x (sorted) of n rows; knots and levels."""
    blocks: list[list[float]] = []
    for a, w, s in zip(x, n, y):
        blocks.append([a * w, w, s])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics `x` of every row."""
    small_batches(docs.sparkSession)

    def each(batches):
        for b in batches:
            x = [statistics(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, x array<double>")


def fit(train: DataFrame, waves: int = 192, ridge: float = 1e-4, seed: int = 7) -> Model | None:
    """Model of rows (x, y, part): part 0 calibrates, all others fit. None without rows.

    Moments, normal equations and calibration bins are sums over partitions: what reaches the
    driver depends on the number of features alone.
    """
    d = STATISTICS

    def moments(batches):
        total = np.zeros(2 * d + 1)
        for b in batches:
            x = matrix(b.column("x"), d, "f8")
            total += np.r_[len(x), x.sum(0), (x * x).sum(0)]
        return total

    sums = summed(train.select("x"), moments, 2 * d + 1)
    if not sums[0]:
        return None
    mean = sums[1 : d + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[d + 1 :] / sums[0] - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(size=(d, waves)) / np.sqrt(d) * 1.5, rng.uniform(0, 2 * np.pi, waves), np.zeros(1), np.zeros(1), np.zeros(1))
    k = 1 + d + waves

    def normal(batches):
        total = np.zeros((k, k + 2))
        for b in batches:
            f, y = model.features(matrix(b.column("x"), d, "f8")), b.column("y").to_numpy()
            total[:, :k] += f.T @ f
            total[:, k] += f.T @ y
            total[0, k + 1] += len(f)
        return total.ravel()

    fitted = train.where("part <> 0")
    if not fitted.head(1):
        fitted = train
    total = summed(fitted.select("x", F.col("y").cast("double").alias("y")), normal, k * (k + 2)).reshape(k, k + 2)
    rows = total[0, k + 1]
    model.weights = np.linalg.solve(total[:, :k] / rows + ridge * np.eye(k), total[:, k] / rows)

    def bins(batches):
        total = np.zeros(3 * LEVELS)
        for b in batches:
            raw, y = np.clip(model.raw(matrix(b.column("x"), d, "f8")), -0.5, 1.5), b.column("y").to_numpy()
            at = np.minimum(((raw + 0.5) / 2 * LEVELS).astype(int), LEVELS - 1)
            total[:LEVELS] += np.bincount(at, minlength=LEVELS)
            total[LEVELS : 2 * LEVELS] += np.bincount(at, raw, LEVELS)
            total[2 * LEVELS :] += np.bincount(at, y, LEVELS)
        return total

    checked = train.where("part = 0")
    if not checked.head(1):
        checked = train
    n, x, y = summed(checked.select("x", F.col("y").cast("double").alias("y")), bins, 3 * LEVELS).reshape(3, LEVELS)
    used = n > 0
    model.knots, model.values = isotonic(x[used] / n[used], n[used], y[used])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, learnable, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row of docs.

    labels: (doc_id, quality 0/1); `learnable` is a condition on doc_id. Null labels and labels of
    unknown ids teach nothing; every copy of a repeated id or label counts as a row. Null and empty
    texts have statistics zero and are scored like any other. Without a learnable label every score
    is 0.5. Only doc_id and text of docs are read. Texts are read once: what is kept of each is a
    row of statistics, joined with the labels and scored.
    """
    x = settle(described(docs))
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4))
    known = labels.where(learnable).where("quality is not null").select("doc_id", F.col("quality").alias("y"))
    train = settle(x.join(known, "doc_id").select("x", "y", part.alias("part")))
    model = fit(train)

    def each(batches):
        for b in batches:
            rows = matrix(b.column("x"), STATISTICS, "f8")
            s = model.score(rows) if model and len(rows) else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype("i4"))], names=["doc_id", "score", "predicted"])

    return x.mapInArrow(each, "doc_id long, score double, predicted int")
