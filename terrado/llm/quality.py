"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel; the normal equations are summed by
partition and solved once. Statistics are taken from whole texts, for all rows;
the fit uses at most `sample` labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrado.llm.common import materialize, slices, texts_of, utf8
from terrado.llm.labelled import Isotonic, fold, sample_labels

#: Labelled rows that the fit uses at most.
SAMPLE = 20_000
#: Random Fourier features.
FEATURES = 384
#: Width of the kernel, in standard deviations of a statistic times the root of their number.
WIDTH = 1.0
RIDGE = 1e-3
#: Parts of 100 of the sample that fit the ridge; the others calibrate.
FIT_PARTS = 70
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
N_STATISTICS = 22

_LOWER, _UPPER, _DIGIT, _SPACE = (np.zeros(256, bool) for _ in range(4))
_LOWER[97:123], _UPPER[65:91], _DIGIT[48:58], _SPACE[[9, 10, 11, 12, 13, 32]] = True, True, True, True
_HIGH = np.arange(256) >= 128
_MARK = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH)
_USUAL = np.isin(np.arange(256), [ord(x) for x in ".,;:'\"()-"])


def statistics(text: bytes) -> list[float]:
    """N_STATISTICS numbers of a whole text; all zero if it has no bytes."""
    n = len(text)
    if not n:
        return [0.0] * N_STATISTICS
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    letters = max(1, int(counts[_LOWER].sum() + counts[_UPPER].sum() + counts[_HIGH].sum()))
    upper, odd = int(counts[_UPPER].sum()), int(counts[_MARK & ~_USUAL].sum())
    times = Counter(words)
    most = max(times.values(), default=0)
    repeats = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x]
    line_repeats = len(lines) - len(set(lines))
    log = np.log1p
    return [
        log(n),
        log(len(words)),
        n / m / 10,
        len(times) / m,
        most / m,
        repeats / m,
        log(repeats),
        upper / letters,
        log(upper),
        odd / n,
        log(odd),
        odd / m,
        counts[_USUAL].sum() / n,
        counts[_DIGIT].sum() / n,
        log(counts[_DIGIT].sum()),
        counts[_HIGH].sum() / n,
        len(lines) / m,
        log(line_repeats),
        line_repeats / max(1, len(lines)),
        counts[ord(".")] / m,
        max(map(len, words), default=0) / 100,
        n / max(1, len(lines)) / 1000,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of N_STATISTICS doubles); one row per row of docs."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([statistics(t) for t in utf8(batch.column(1))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), x], names=["doc_id", "x"])

    return texts_of(docs, id_col, text_col).mapInArrow(over, "doc_id long, x array<double>")


class Fourier:
    """Standardised statistics to random Fourier features with a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.w = draw.normal(size=(len(mean), features)) / (width * np.sqrt(len(mean)))
        self.b = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    aggregates = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(N_STATISTICS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = rows.agg(*aggregates).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(N_STATISTICS)])
    deviation = np.array([row[f"s{i}"] or 0.0 for i in range(N_STATISTICS)])
    return mean, np.where(deviation > 1e-9, deviation, 1.0)


def normal_equations(rows: DataFrame, features: Fourier) -> tuple[np.ndarray, np.ndarray, int]:
    """Z'Z, Z'y and the row count, summed within each partition and then over the few partitions of a sample."""
    size = len(features.b) + 1

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in slices(batches):
            z = features(_matrix(batch.column(0), N_STATISTICS))
            a += z.T @ z
            b += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
            n += len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["a", "b", "n"])

    sums = rows.select("x", "y").mapInArrow(over, "a binary, b binary, n long").collect()
    a, b = np.zeros((size, size)), np.zeros(size)
    for r in sums:
        a += np.frombuffer(r["a"]).reshape(size, size)
        b += np.frombuffer(r["b"])
    return a, b, sum(r["n"] for r in sums)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    features: int = FEATURES,
    width: float = WIDTH,
    ridge: float = RIDGE,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Labels are learned only outside the held-out fold, from at most `sample`
    rows; of ids labelled twice the mean counts. Null texts are scored as empty
    ones. Without labels, or with one label only, all scores are that mean (0.5
    without any).
    """
    stats = materialize(document_statistics(docs, id_col, text_col))
    chosen = sample_labels(labels, label_col, folds, held_out, sample)
    # the sample is bounded by `sample` ids; of rows that repeat an id those of the smallest statistics count
    known = materialize(stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("x", "y", "part")).alias("one")).select("doc_id", "one.*").repartition(4, "doc_id"))
    mean, deviation = _moments(known)
    fourier = Fourier(mean, deviation, features, width)
    a, b, n = normal_equations(known.where(F.col("part") < FIT_PARTS), fourier)
    weights = np.linalg.solve(a + ridge * max(1, n) * np.diag([1.0] * features + [1e-6]), b) if n else np.zeros(features + 1)
    rest = known.where(F.col("part") >= FIT_PARTS).select("x", "y").limit(sample).collect()
    y = np.array([r["y"] for r in rest])
    raw = fourier(np.array([r["x"] for r in rest])) @ weights if rest else np.zeros(0)
    calibrated = Isotonic(raw, y)
    share = float(np.mean(y)) if rest else 0.5
    learned = n > 0 and 0 < share < 1

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = _matrix(batch.column(1), N_STATISTICS)
            score = calibrated(fourier(x) @ weights) if learned else np.full(len(x), share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "score"])

    scored = stats.mapInArrow(over, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
