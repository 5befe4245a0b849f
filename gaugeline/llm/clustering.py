"""k-means over whole-number vectors with Shallot's search for the nearest centroid.

Each vector keeps its nearest and second-nearest centroid, an upper bound on the distance to the
nearest and a lower bound on the distance to all others. When centroids have moved, most vectors are
settled by the bounds. The rest measure both remembered centroids and search around the closer one:
its neighbours, sorted by distance, are tried outwards, and the ball ends where no centroid further
out can be second nearest; each better one that is found shrinks it. Bounds are floating point with a
margin; whatever they leave open is compared in whole numbers, ties go to the smaller number.

A pass over the vectors writes them with their bounds, and at the end of each task the sums of its
clusters as extra rows of the same table, so a round is one scan and no shuffle of vectors.

Defined results: vectors that are null, of another length, or with a null or non-finite component are
left out; rows with equal ids are vectors of their own; with fewer vectors than `k`, each is a
centroid; a null id comes last among the starting ones. Components beyond 2^26 after scaling raise an
error, since their distances may not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.session import discard, settle

LARGEST = 1 << 26
#: Relative margin of the bounds, far above the rounding of a few additions and square roots.
_MARGIN = 1e-9


class Centroids:
    """Centroids with what the search needs: distances, neighbours by distance, half gaps."""

    def __init__(self, vectors: np.ndarray, before: np.ndarray | None = None):
        self.vectors = vectors
        k = len(vectors)
        gap = np.sqrt(squared(vectors[:, None, :], vectors[None, :, :]).astype(float))
        self.order = np.argsort(gap, axis=1, kind="stable")
        # The centroid itself comes first, also before others at its place.
        for c in range(k):
            row = self.order[c]
            self.order[c] = np.concatenate([[c], row[row != c]])
        self.gap = np.take_along_axis(gap, self.order, axis=1)
        self.half = self.gap[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(squared(vectors, before).astype(float))
        self.moved = moved
        # The furthest that any other centroid has moved.
        self.others = np.array([np.delete(moved, c).max(initial=0.0) for c in range(k)])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.einsum("...i,...i->...", gap, gap)


def _less(d: np.ndarray, c: np.ndarray, than_d: np.ndarray, than_c: np.ndarray) -> np.ndarray:
    return (d < than_d) | (d == than_d) & (c < than_c)


def assign(
    x: np.ndarray, centroids: Centroids, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest, second nearest, their bounds, and the squared distance to the nearest.

    `near`, `second`, `upper`, `lower` are those of the round before; `upper` infinite and `lower`
    zero say nothing is known.
    """
    c = centroids.vectors
    k = len(c)
    near, second = near.astype(np.int64), second.astype(np.int64)
    upper = (upper + centroids.moved[near]) * (1 + _MARGIN)
    lower = np.maximum(lower - centroids.others[near], 0) * (1 - _MARGIN)
    distance = squared(x, c[near])
    if k == 1:
        return near, second, np.sqrt(distance.astype(float)), lower, distance
    bound = np.maximum(lower, centroids.half[near] * (1 - _MARGIN))
    still = np.flatnonzero(~(upper < bound))
    upper = np.sqrt(distance.astype(float)) * (1 + _MARGIN)
    still = still[~(upper[still] < bound[still])]
    if not len(still):
        return near, second, upper, lower, distance
    own = x[still]
    best, best_d = near[still], distance[still]
    next_, next_d = second[still], squared(own, c[second[still]])
    swap = _less(next_d, next_, best_d, best)
    best, next_ = np.where(swap, next_, best), np.where(swap, best, next_)
    best_d, next_d = np.where(swap, next_d, best_d), np.where(swap, best_d, next_d)
    start, other, radius = best.copy(), next_.copy(), np.sqrt(best_d.astype(float))
    going = np.arange(len(still))
    for place in range(1, k):
        ball = (radius[going] + np.sqrt(next_d[going].astype(float))) * (1 + _MARGIN)
        going = going[centroids.gap[start[going], place] <= ball]
        if not len(going):
            break
        tried = centroids.order[start[going], place]
        fresh = tried != other[going]
        at, tried = going[fresh], tried[fresh]
        d = squared(own[at], c[tried])
        first = _less(d, tried, best_d[at], best[at])
        then = ~first & _less(d, tried, next_d[at], next_[at])
        one = at[first]
        next_[one], next_d[one] = best[one], best_d[one]
        best[one], best_d[one] = tried[first], d[first]
        two = at[then]
        next_[two], next_d[two] = tried[then], d[then]
    near[still], second[still], distance[still] = best, next_, best_d
    upper[still] = np.sqrt(best_d.astype(float)) * (1 + _MARGIN)
    lower[still] = np.sqrt(next_d.astype(float)) * (1 - _MARGIN)
    return near, second, upper, lower, distance


def whole_vectors(df: DataFrame, vec_id: str, embedding: str, size: int, scale: int) -> DataFrame:
    """(id, v): the vectors that take part, each component floor(scale * component)."""
    v = F.col(f"`{embedding}`")
    usable = F.size(v) == size
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    rows = df.where(v.isNotNull() & usable & finite).select(
        F.col(f"`{vec_id}`").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return rows.select("id", F.when(fits, F.transform("v", lambda x: x.cast("int"))).otherwise(
        F.raise_error(F.lit("a component is too large for exact distances"))).alias("v"))


def _ints(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _pass(df: DataFrame, id_type: str, centroids: Centroids, size: int, last: bool) -> DataFrame:
    """Vectors with their nearest centroid, and after them a row of sums for each cluster and task."""
    k = len(centroids.vectors)
    known = "near" in df.columns
    kinds = [("near", pa.int32()), ("second", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64())]
    names = ["id", "v", *[n for n, _ in kinds], "distance", "n", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        id_kind = pa.null()
        for batch in batches:
            rows = batch.num_rows
            id_kind = batch.column(0).type
            if not rows:
                continue
            x = _ints(batch.column(1), size)
            if known:
                state = [batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(4)]
            else:
                state = [np.zeros(rows, int), np.full(rows, min(1, k - 1)), np.full(rows, np.inf), np.zeros(rows)]
            near, *rest, distance = assign(x, centroids, *state)
            n += np.bincount(near, minlength=k)
            np.add.at(inertia, near, distance)
            if not last:
                for c in np.unique(near):
                    sums[c] += x[near == c].sum(axis=0)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.nulls(rows, pa.list_(pa.int32())) if last else batch.column(1),
                *[pa.array(a, t) for a, (_, t) in zip([near, *rest], kinds)], pa.array(distance),
                pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(pa.int64()))], names=names)
        used = np.flatnonzero(n)
        if len(used):
            m = len(used)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(m, id_kind), pa.nulls(m, pa.list_(pa.int32())), pa.array(used, pa.int32()),
                *[pa.nulls(m, t) for _, t in kinds[1:]], pa.array(inertia[used]), pa.array(n[used]),
                pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=names)

    schema = (f"id {id_type}, v array<int>, near int, second int, upper double, lower double, "
              "distance long, n long, sums array<long>")
    return df.select("id", "v", *([c for c, _ in kinds] if known else [])).mapInArrow(run, schema)


def starting(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The `k` vectors with the smallest SHA-256 of `seed:id`, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def cluster_vectors(
    df: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance) of each vector that takes part, and a row for each cluster.

    The second table has `cluster`, `n`, `cluster_inertia`, `inertia` and `centroid`. Between rounds
    the sums of k clusters come to the driver; a cluster's new centroid is floor(sum / n) of its own.
    Each pass writes the vectors anew with their bounds, and the table before it is deleted.
    """
    table = whole_vectors(df, vec_id, embedding, size, scale)
    kind = table.schema["id"].dataType.simpleString()
    vectors = starting(table, k, seed)
    clusters = "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>"
    if not len(vectors):
        none = df.sparkSession.createDataFrame([], clusters)
        return table.select(F.col("id").alias(vec_id), F.lit(0).alias("cluster"),
                            F.lit(0).cast("long").alias("distance")).limit(0), none
    before, own, old = None, table, None
    for round_ in range(rounds + 1):
        last = round_ == rounds
        written = settle(_pass(own, kind, Centroids(vectors, before), size, last))
        if old is not None:
            discard(old)
        old = written
        parts = written.where("n IS NOT NULL")
        if last:
            break
        sums = parts.groupBy("near").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums")).collect()
        before, vectors = vectors, vectors.copy()
        for r in sums:
            vectors[r["near"]] = [s // r["n"] for s in r["sums"]]
        own = written.where("n IS NULL")
    found = {r["near"]: r for r in parts.groupBy("near").agg(
        F.sum("n").alias("n"), F.sum("distance").alias("inertia")).collect()}
    whole = sum(r["inertia"] for r in found.values())
    rows = [(c, found[c]["n"] if c in found else 0, found[c]["inertia"] if c in found else 0, whole, v.tolist())
            for c, v in enumerate(vectors)]
    members = written.where("n IS NULL").select(
        F.col("id").alias(vec_id), F.col("near").alias("cluster"), "distance")
    return members, df.sparkSession.createDataFrame(rows, clusters)
