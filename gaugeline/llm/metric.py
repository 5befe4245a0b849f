"""Near-duplicate vectors: an exact metric range join in cells around pivots.

Vectors of one label are scaled to length one, where a cosine limit is a distance limit. Each vector
belongs to the cell of its nearest pivot. By the triangle inequality a vector can only be within the
limit of a cell's vectors if it is at most twice the limit farther from that cell's pivot than from
its own, so it is also sent there; a sharper bound from the line between the two pivots is applied
too. A cell that is still large gets pivots of its own, chosen among its vectors, and is split by the
same bounds, which hold for vectors sent to it as well. Every cell then finds all neighbours of its own
vectors by itself. What stays large is dealt out in pairs of blocks. Cells give counts and a spanning
forest of their links, never pairs.

Equal vectors of a label are one node with a count. Defined results: a vector that is null, zero,
or holds null or non-finite components, and one whose label is null, links with nothing; vectors of
different lengths never link; rows with a null id are compared like others (see `near_vectors` for
their component); rows with equal ids and equal vectors count as two; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.components import components, with_least_id
from gaugeline.session import settle

#: Distinct vectors that share a cell before pivots are used, for a label.
CELL = 8192
#: Pivots of all labels together; they are broadcast (1,024 of 64 doubles: half a megabyte).
MOST_PIVOTS = 1024
#: Pivots inside all large cells together, broadcast too (65,536 of 64 doubles: 34 megabytes).
MOST_INNER_PIVOTS = 65536
#: Vectors a pivot is picked from.
SAMPLE = 64
#: Vectors of a cell compared at once.
BLOCK = 4096


def _unit(column: pa.Array) -> np.ndarray:
    lists = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = lists.reshape(len(column), -1)
    # Powers of two first, which change no digit: squares of very large or small components do not fit.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


class Forest:
    """Union-find over positions, smallest position first."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The links that joined two trees."""
        kept = []
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append((i, j))
        return kept


def _beyond(x: np.ndarray, p: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and the other pivots whose cells may hold a neighbour of it."""
    far = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
    near = far.argmin(axis=1)
    least = far[np.arange(len(x)), near][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[near]
    over = far - least <= 2 * reach
    over &= far ** 2 - least ** 2 <= 2 * reach * apart + 1e-9
    over[np.arange(len(x)), near] = False
    return near, over


def _pivots(members: DataFrame, cell: int, most: int, reach: float, paying: bool) -> dict[tuple, np.ndarray]:
    """Pivots by (label, dim, cell) of the cells with more than `cell` vectors of their own, the largest
    first, `most` in all. One job picks them, each cell's from a bounded number of its vectors.

    With `paying`, a cell gets none where its vectors would go to more than half of its new cells.
    """
    where = ["label", "dim", "cell"]
    sizes = settle(members.where("own").groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
                   .orderBy(F.desc("n"), *where).limit(most // 2))
    share = F.ceil(F.col("n") / cell)
    total = sizes.agg(F.sum(share)).first()[0]
    if not total:
        return {}
    if total > most:
        share = F.greatest(F.lit(2), F.floor(share * most / total))
    wanted = sizes.select(*where, "n", share.cast("int").alias("wanted"))
    every = F.greatest(F.lit(1), F.floor(F.col("n") / (SAMPLE * F.col("wanted"))))
    sample = (members.where("own").join(F.broadcast(wanted), where)
              .where(F.pmod(F.xxhash64("node"), every) == 0).select(*where, "wanted", "vector"))

    def pick(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        vectors, n = group.column("vector").combine_chunks(), group.column("wanted")[0].as_py()
        x = _unit(vectors)
        picked = [0]
        far = np.linalg.norm(x - x[0], axis=1)
        while len(picked) < min(n, len(x)):
            picked.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(x - x[picked[-1]], axis=1))
        if paying and (1 + _beyond(x, x[picked], reach)[1].sum(axis=1).mean()) * 2 > len(picked):
            picked = []
        return group.select([*where, "vector"]).take(pa.array(picked, pa.int64()))

    kind = members.schema["label"].dataType.simpleString()
    rows = sample.groupBy(*where).applyInArrow(
        pick, f"label {kind}, dim int, cell long, vector array<double>").collect()
    found: dict[tuple, list] = {}
    for r in rows:
        found.setdefault((r.label, r.dim, r.cell), []).append(r.vector)
    return {k: _unit(pa.array(v, pa.list_(pa.float64()))) for k, v in found.items()}


def _split(members: DataFrame, pivots: dict[tuple, np.ndarray], reach: float) -> DataFrame:
    """Members of cells that have pivots, in the cells of these; others keep theirs under a new number."""
    names = ["label", "vector", "node", "copies", "dim", "cell", "own"]

    def split(batches):
        for batch in batches:
            cell = batch.column(5).to_numpy()
            own = batch.column(6).to_numpy(zero_copy_only=False)
            kinds: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), cell.tolist())):
                if k in pivots:
                    kinds.setdefault(k, []).append(i)
            target = cell << 20
            places, targets, owns = [np.arange(batch.num_rows)], [target], [own]
            for k, at in kinds.items():
                at = np.array(at)
                near, over = _beyond(_unit(batch.column(1).take(pa.array(at))), pivots[k], reach)
                target[at] += near
                i, j = np.nonzero(over)
                places.append(at[i])
                targets.append((cell[at[i]] << 20) + j)
                owns.append(np.zeros(len(i), dtype=bool))
            out = batch.take(pa.array(np.concatenate(places)))
            yield pa.RecordBatch.from_arrays(
                [*out.columns[:5], pa.array(np.concatenate(targets)), pa.array(np.concatenate(owns))], names=names)

    kind = members.schema["label"].dataType.simpleString()
    return settle(members.select(*names).mapInArrow(
        split, f"label {kind}, vector array<double>, node long, copies long, dim int, cell long, own boolean"))


def near_vectors(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    least_cosine: float = 0.98, cell: int = CELL, most_pivots: int = MOST_PIVOTS, block: int = BLOCK,
    most_inner_pivots: int = MOST_INNER_PIVOTS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): all pairs of one label with a cosine of at least
    `least_cosine` are linked. A component's id is its smallest id that is not null; a row is kept
    if its id is the component's, or both are null."""
    rows = settle(df.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").alias("vec_id"),
        F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    ))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & whole & F.exists("vector", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    nodes = settle(good.groupBy("label", "vector").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.size(F.first("vector")).alias("dim")))
    # A hair more than the limit, so that rounding sends a vector too far rather than not.
    reach = float(np.sqrt(max(2 - 2 * least_cosine, 0.0))) + 1e-7
    sent = nodes.select("label", "vector", "node", "copies", "dim", F.lit(0).cast("long").alias("cell"),
                        F.lit(True).alias("own"))
    for most, paying in ((most_pivots, False), (most_inner_pivots, True)):
        # Labels or cells beyond the number of pivots stay whole; no more rows than that come here.
        pivots = _pivots(sent, cell, most, reach, paying)
        if not pivots:
            break
        sent = _split(sent, pivots, reach)
    where = ["label", "dim", "cell"]
    blocks = sent.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        sent.join(blocks, where).select("*", part.alias("part"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(*where, F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                "part", "own", "node", "copies", "vector")
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        part, own = group.column("part").to_numpy(), group.column("own").to_numpy(zero_copy_only=False)
        node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        x = _unit(group.column("vector").combine_chunks())
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        left = np.flatnonzero(part == low)
        right = left if low == high else np.flatnonzero(part == high)
        count, forest = np.zeros(len(node), dtype=np.int64), Forest(len(node))
        tree: list[tuple[int, int]] = []
        for at in range(0, len(left), 512):
            a = left[at:at + 512]
            # Pairs of two copies sent from elsewhere are found where one of them is at home.
            i, j = np.nonzero((x[a] @ x[right].T >= least_cosine) & (own[a][:, None] | own[right][None, :]))
            i, j = a[i], right[j]
            if low == high:
                i, j = i[i != j], j[i != j]
            count += np.bincount(i, np.where(own[i], copies[j], 0), minlength=len(node)).astype(np.int64)
            if low != high:
                count += np.bincount(j, np.where(own[j], copies[i], 0), minlength=len(node)).astype(np.int64)
            tree += forest.link(i, j)
        a, b = (np.array([t[k] for t in tree], dtype=np.int64) for k in (0, 1))
        at = np.flatnonzero(count)
        none = [None] * len(at)
        return pa.table({
            "a": pa.array(node[at].tolist() + node[a].tolist(), pa.int64()),
            "b": pa.array(none + node[b].tolist(), pa.int64()),
            "links": pa.array(count[at].tolist() + [None] * len(a), pa.int64()),
        })

    found = settle(dealt.groupBy(*where, "low", "high").applyInArrow(compare, "a long, b long, links long"))
    counts = (found.where(F.col("links").isNotNull()).groupBy(F.col("a").alias("node"))
              .agg(F.sum("links").alias("links")))
    by_node = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    known = (
        nodes.select("label", "vector", "node", "copies")
        .join(counts, "node", "left").join(by_node, "node", "left")
        .select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "node").alias("component"))
    )
    linked = settle(good.join(known, ["label", "vector"]).select("vec_id", "n_links", "component"))
    out = with_least_id(linked, "vec_id")
    alone = rows.where(~usable).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
