"""Pivots inside large cells: same links as all pairs, and work that grows with the vectors only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import metric
from gaugeline.session import settle


def clustered(n, seed, dim=16, bundle=125):
    """Groups of about eight vectors around directions of their own, in far-apart bundles of `bundle`."""
    draw = np.random.default_rng(seed)
    bundles = draw.normal(size=(n // bundle, dim))
    centres = bundles[draw.integers(0, n // bundle, n // 8)] + 0.35 * draw.normal(size=(n // 8, dim))
    return centres[draw.integers(0, n // 8, n)] + 0.03 * draw.normal(size=(n, dim))


def frame(spark, x, labels):
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def plain(x, labels, least=0.98):
    """Links and least ids by all pairs."""
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= least) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    least_id = np.arange(len(x))
    while True:
        now = np.array([min(least_id[i], least_id[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (now == least_id).all():
            return {i: (int(near[i].sum()), int(now[i])) for i in range(len(x))}
        least_id = now


@pytest.mark.parametrize("cell, outer, inner", [(20, 4, 64), (50, 2, 8), (10, 64, 1000), (20, 2, 2)])
def test_links_equal_all_pairs(spark, cell, outer, inner):
    x, labels = clustered(1500, 3), [0] * 1200 + [1] * 300
    out = metric.near_vectors(frame(spark, x, labels), cell=cell, most_pivots=outer, most_inner_pivots=inner, block=64)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == plain(x, labels)


def work(spark, n, inner):
    """Compared pairs a vector: own vectors of each cell by all of it."""
    df = frame(spark, clustered(n, 11), [0] * n)
    sent = df.select("label", F.col("embedding").alias("vector"), F.col("vec_id").alias("node"),
                     F.lit(1).cast("long").alias("copies"), F.lit(16).alias("dim"),
                     F.lit(0).cast("long").alias("cell"), F.lit(True).alias("own"))
    sent = settle(sent)
    for most, paying in ((8, False), (inner, True)):
        pivots = metric._pivots(sent, 100, most, 0.1, paying)
        sent = metric._split(sent, pivots, 0.1) if pivots else sent
    assert sent.where("own").count() == n
    cells = sent.groupBy("cell").agg(F.count_if("own").alias("own"), F.count("*").alias("every"))
    return cells.agg(F.sum(F.col("own") * F.col("every"))).first()[0] / n


def test_work_a_vector_grows_slowly(spark):
    """Four times the vectors with as many near each: with eight outer pivots alone a vector meets four times
    as many; with inner ones less than twice, which is what more borders between cells cost."""
    small, large = (work(spark, n, 4096) for n in (4000, 16000))
    alone = [work(spark, n, 0) for n in (4000, 16000)]
    assert alone[1] > 3.5 * alone[0] and large < 2 * small and large < alone[1] / 6


def test_vectors_without_clusters_are_not_sent_everywhere(spark):
    """Where inner cells would get most vectors anyhow, cells stay whole."""
    x = np.random.default_rng(1).normal(size=(3000, 64))
    df = frame(spark, x, [0] * 3000).select(
        "label", F.col("embedding").alias("vector"), F.col("vec_id").alias("node"),
        F.lit(1).cast("long").alias("copies"), F.lit(64).alias("dim"), F.lit(0).cast("long").alias("cell"),
        F.lit(True).alias("own"))
    assert metric._pivots(settle(df), 100, 4096, 0.6, True) == {}
