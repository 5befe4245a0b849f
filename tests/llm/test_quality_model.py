"""The fitted model and its scores against the same sums in plain numpy."""

import random
import zlib

import numpy as np
import pytest

from gaugeline.llm import quality


def pooled(counts, sums):
    """Non-decreasing means: the largest, over beginnings, of the least mean up to an end."""
    n = len(counts)
    mean = lambda i, j: sum(sums[i:j]) / sum(counts[i:j])
    return [max(min(mean(i, j) for j in range(k + 1, n + 1)) for i in range(k + 1)) for k in range(n)]


def test_scores_against_plain_numpy(spark):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        words = [("".join(draw.choice("aeinorst") for _ in range(draw.randrange(2, 9))) if good or draw.random() < 0.6
                  else draw.choice(["###", "$$$$", "A", "9999", "buy"])) for _ in range(draw.randrange(5, 60))]
        rows.append((i, " ".join(words) + ("." if good else "")))
        if i % 4:
            labels.append((i, int(good)))
    rows += [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(9001, None), (None, 1)], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    model = quality.fit(quality.training_rows(stats, known, "quality"), n_features=40)
    mine = {r.doc_id: (r.score, r.predicted) for r in quality.score(stats, model).collect()}

    table = {r.doc_id: np.array(r.stats) for r in stats.collect()}
    train = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([table[i] for i, _ in train]), np.array([y for _, y in train], float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-12] = 1.0
    state = np.random.RandomState(7)
    directions, phases = state.normal(size=(x.shape[1], 40)) / 4.0, state.uniform(0, 2 * np.pi, 40)

    def features(s):
        z = np.sqrt(2 / 40) * np.cos(np.clip((s - mean) / scale, -6, 6) @ directions + phases)
        return np.column_stack([z, np.ones(len(z))])

    z = features(x)
    penalty = np.diag([1e-3 * len(y) / 40] * 40 + [1e-9 * len(y)])
    weights = np.linalg.lstsq(z.T @ z + penalty, z.T @ y, rcond=None)[0]
    width = (quality._HIGH_SCORE - quality._LOW) / quality.GRID
    cell = np.clip((z @ weights - quality._LOW) / width, 0, quality.GRID - 1).astype(int)
    used = sorted(set(cell))
    values = pooled([int((cell == c).sum()) for c in used], [float(y[cell == c].sum()) for c in used])
    steps = [quality._LOW + (c + 0.5) * width for c in used]
    ids = sorted(table)
    wanted = np.interp(features(np.array([table[i] for i in ids])) @ weights, steps, values)
    for i, s in zip(ids, wanted):
        assert mine[i][0] == pytest.approx(s, abs=1e-5) and mine[i][1] == int(mine[i][0] >= 0.3)
    right = [mine[i][1] == y for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(right) > 0.8
    # The kernel that the features stand for.
    a, b = (x[:60] - mean) / scale, (x[60:120] - mean) / scale
    many = quality.fit(quality.training_rows(stats, known, "quality"), n_features=6000)
    close = many.features(x[:60])[:, :-1] @ many.features(x[60:120])[:, :-1].T
    gauss = np.exp(-((np.clip(a, -6, 6)[:, None] - np.clip(b, -6, 6)[None]) ** 2).sum(axis=2) / (2 * 4.0 ** 2))
    assert np.abs(close - gauss).max() < 0.1
