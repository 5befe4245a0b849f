"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

Each text becomes a short row of statistics (`STATISTICS`). Cosines of random projections of the
standardised statistics approximate a Gaussian kernel. The normal equations of the ridge fit are
summed inside each partition and then over partitions; only the summed matrix, of a fixed size,
reaches the driver. Ridge scores are calibrated by isotonic regression over counts on a fixed grid.

Defined results: a null or empty text has zeros as statistics and is scored like any other; labels
that are null or belong to no row are not used, a row with several labels counts once for each;
rows with a null id are scored but never trained on; with no usable label every score is 0.5; rows
are scored one by one, so repeated rows and ties get equal scores; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm.text import BLANKS, LOWER, Texts, byte_set, give_back, mixed, run_hashes, runs, texts_of

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digits", "non_ascii",
    "stops", "exclaims", "bars", "marks", "other_punctuation", "line_breaks", "distinct_words",
    "top_word", "same_as_before", "same_pair", "marked_words", "capital_words", "line_words",
)

_UPPER = byte_set(bytes(range(65, 91)))
_DIGIT = byte_set(bytes(range(48, 58)))
_HIGH = byte_set(bytes(range(128, 256)))
_CONTINUED = byte_set(bytes(range(128, 192)))
_STOP = byte_set(b".,;:?")
_EXCLAIM = byte_set(b"!")
_BAR = byte_set(b"|")
_MARK = byte_set(b"#*$%&<>")
_LETTER = byte_set(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_OTHER = ~(_LETTER | _DIGIT | BLANKS | _STOP | _EXCLAIM | _BAR | _MARK)
_BREAK = byte_set(b"\n")

#: Cells of the grid on which ridge scores are counted for calibration.
GRID = 4096
_LOW, _HIGH_SCORE = -1.0, 2.0


def statistics(texts: Texts) -> np.ndarray:
    """One row of `STATISTICS` for each text."""
    n, data = len(texts), texts.data
    words = runs(texts, BLANKS)
    n_words = np.bincount(words.text, minlength=n)
    some, chars = np.maximum(n_words, 1), texts.count(~_CONTINUED[data])
    size = np.maximum(chars, 1)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(words.text, length, minlength=n) / some
    spread = np.bincount(words.text, (length - mean[words.text]) ** 2, minlength=n) / some

    with np.errstate(over="ignore"):
        plain = run_hashes(LOWER[data], words)
        own = mixed(plain + words.text.astype(np.uint64))
    _, first, times = np.unique(own, return_index=True, return_counts=True)
    distinct = np.bincount(words.text[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, words.text[first], times)
    same = np.zeros(n)
    pair = np.zeros(n)
    if len(own) > 2:
        same += np.bincount(words.text[1:], own[1:] == own[:-1], minlength=n)
        with np.errstate(over="ignore"):
            both = mixed(own[:-1] * np.uint64(3) + own[1:])[words.text[1:] == words.text[:-1]]
        owner = words.text[1:][words.text[1:] == words.text[:-1]]
        _, at = np.unique(both, return_index=True)
        pair += np.bincount(owner, minlength=n) - np.bincount(owner[at], minlength=n)

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[data])])
        return total[words.end] - total[words.start]

    marked = np.bincount(words.text, inside(_MARK | _BAR | _EXCLAIM) > 0, minlength=n)
    capital = np.bincount(words.text, (inside(_UPPER) >= 2), minlength=n)
    breaks = texts.count(_BREAK[data])
    shares = [texts.count(m[data]) / size for m in
              (_UPPER, _DIGIT, _HIGH, _STOP, _EXCLAIM, _BAR, _MARK, _OTHER, _BREAK)]
    return np.column_stack([
        np.log1p(chars), np.log1p(n_words), mean, np.sqrt(spread), *shares,
        distinct / some, top / some, same / some, pair / some, marked / some, capital / some,
        np.log1p(n_words / (breaks + 1)),
    ])


def document_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats) of each row's whole text."""
    own = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("stats", T.ArrayType(T.DoubleType(), False))])

    def rows(batches):
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                found = statistics(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(texts.first, len(texts)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]),
                        pa.array(found.ravel())),
                ], names=schema.names)
        give_back()

    return own.mapInArrow(rows, schema)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Everything a score needs; its size depends on the settings only."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.values)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators, for cells in ascending order."""
    pooled: list[list[float]] = []
    for n, s in zip(counts.tolist(), sums.tolist()):
        pooled.append([n, s, 1])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][0] >= pooled[-1][1] * pooled[-2][0]:
            n2, s2, k2 = pooled.pop()
            pooled[-1] = [pooled[-1][0] + n2, pooled[-1][1] + s2, pooled[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / n) for n, s, k in pooled])


def fit(train: DataFrame, n_features: int = 256, ridge: float = 1e-3, width: float = 4.0,
        seed: int = 7, sum_tasks: int = 8) -> Model | None:
    """A model from rows (stats, label); None without rows. `width` is the kernel's, in deviations."""
    d = len(STATISTICS)
    at = [F.col("stats")[i] for i in range(d)]
    moments = train.agg(F.count(F.lit(1)), *[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
    if not moments[0]:
        return None
    mean, scale = np.array(moments[1:d + 1], float), np.array(moments[d + 1:], float)
    scale = np.where(scale > 1e-12, scale, 1.0)
    random = np.random.RandomState(seed)
    blank = Model(mean, scale, random.normal(size=(d, n_features)) / width,
                  random.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1),
                  np.zeros(1), np.zeros(1))
    size = n_features + 2  # the features, a constant, the label

    def partial(batches):
        total = np.zeros((size, size))
        for batch in batches:
            z = blank.features(_matrix(batch.column(0)))
            z = np.column_stack([z, batch.column(1).to_numpy(zero_copy_only=False)])
            total += z.T @ z
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array(list(total))], names=["line", "cells"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[line] = total.get(line, 0) + cells.values.to_numpy()
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array(list(total.values()))],
                names=["line", "cells"])

    schema = "line int, cells array<double>"
    lines = (
        train.select("stats", F.col("label").cast("double")).mapInArrow(partial, schema)
        .repartition(sum_tasks, "line").mapInArrow(added, schema).collect()
    )
    matrix = np.zeros((size, size))
    for line in lines:
        matrix[line.line] = line.cells
    n = matrix[-2, -2]
    left = matrix[:-1, :-1] + np.diag([ridge * n / n_features] * n_features + [1e-9 * n])
    weights = np.linalg.solve(left, matrix[:-1, -1])
    raw = Model(mean, scale, blank.directions, blank.phases, weights, np.zeros(1), np.zeros(1))

    def cells_of(batches):
        for batch in batches:
            x = raw.raw(_matrix(batch.column(0)))
            cell = np.clip((x - _LOW) / (_HIGH_SCORE - _LOW) * GRID, 0, GRID - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(1)], names=["cell", "label"])

    grid = (
        train.select("stats", F.col("label").cast("double")).mapInArrow(cells_of, "cell int, label double")
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")).collect()
    )
    grid.sort(key=lambda r: r.cell)
    steps = _LOW + (np.array([r.cell for r in grid]) + 0.5) * (_HIGH_SCORE - _LOW) / GRID
    values = isotonic(np.array([r.n for r in grid], float), np.array([r.s for r in grid], float))
    return Model(mean, scale, blank.directions, blank.phases, weights, steps, values)


def score(stats: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) from rows (doc_id, stats)."""
    schema = T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                values = (np.full(batch.num_rows, 0.5) if model is None
                          else model.score(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=schema.names)

    scored = stats.select("doc_id", "stats").mapInArrow(rows, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_rows(stats: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id") -> DataFrame:
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label"))
    known = known.where(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return stats.join(known, "doc_id").select("doc_id", "stats", "label")


def keep_good(df: DataFrame, model: Model | None, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of `df` with a score of at least `threshold`, with their columns as they are."""
    if model is None:
        return df if threshold <= 0.5 else df.limit(0)
    names = [f"k{i}" for i in range(len(df.columns))]
    own = df.toDF(*names)
    at = df.columns.index(text)

    def rows(batches):
        for batch in batches:
            for texts in texts_of(batch.column(at)):
                good = model.score(statistics(texts)) >= threshold
                yield batch.slice(texts.first, len(texts)).filter(pa.array(good))
        give_back()

    return own.mapInArrow(rows, own.schema).toDF(*df.columns)
