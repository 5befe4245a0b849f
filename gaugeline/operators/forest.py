"""Boosting rounds for several goals at once, over blocks of coded rows.

A goal is a column to learn, a quantile of it, and its own dealing of rows to fit, validation and
test. All goals share the codes of the features. Goals of at most some million rows are trained by a task each
(`rounds`). Of more, the blocks are kept by Spark as binary records whose lineage is one written table,
so a lost executor costs a re-read of its blocks. A pass is one job over them: every task answers for all goals still growing, and partial answers of fixed size are added up
on the executors. What comes to the driver is the best split of a node and the value of a leaf; only
of small tables, of which all rounds together send little, partial answers come there themselves.
"""

from __future__ import annotations

import math
import pickle
import random
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline import names as N
from gaugeline.operators import rounds as rounds_
from gaugeline.operators.trees import FIT, LEAF, TEST, VAL, Codes, Goal, Node, best_splits, gains, opened, rank_of
from gaugeline.session import discard, forget, settle

#: Trees a pass walks at most before the running scores are written.
ROUNDS_PER_TABLE = 25
#: Rows of a block: enough to be worth a task, few enough for its memory.
ROWS_PER_TASK, MOST_ROWS = 20_000, 400_000
#: Errors of tasks that come to the driver one by one; more of them are added up by executors first.
MOST_PARTIALS = 32
#: Most bytes of partial answers in all rounds up to which the driver adds them up: a few rounds over
#: some thousand rows.
DRIVER_BYTES = 2 << 20
#: Bytes of partial counts or values for one task to add up; the features of more are dealt to several.
BYTES_PER_SUM = 32 << 20
#: Rows of all goals up to which leaf values take one pass. Of more, a first one with so many values of
#: each leaf and block tells between which two the value lies.
ONE_PASS_ROWS, PROBES = 500_000, 64


class Compiled:
    """A tree as arrays."""

    def __init__(self, tree: Sequence[Node]):
        self.feature = np.array([n.feature for n in tree], dtype=np.int32)
        self.cut = np.array([n.threshold for n in tree], dtype=np.float64)
        self.left = np.array([n.left for n in tree], dtype=np.int32)
        self.right = np.array([n.right for n in tree], dtype=np.int32)
        self.value = np.array([n.value for n in tree])

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node each row ends in; `codes` holds a row of codes for each feature."""
        at = np.zeros(codes.shape[1], dtype=np.int32)
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            node = at[going]
            low = codes[self.feature[node], going] <= self.cut[node]
            at[going] = np.where(low, self.left[node], self.right[node])
            going = going[self.feature[at[going]] >= 0]
        return at


@dataclass
class Block:
    """Codes by feature, and by goal the value, part (-1: not used) and running score of each row."""

    name: str
    codes: np.ndarray
    y: np.ndarray
    part: np.ndarray
    score: np.ndarray


# Scores that a worker has brought up to date, by block: a pass walks the trees it has not walked yet.
# What is not here any more is walked again from the scores in the block.
_KNOWN: OrderedDict[str, tuple[int, np.ndarray]] = OrderedDict()
_KNOWN_BYTES = 256 << 20


def _scores(block: Block, pending: Sequence[Sequence[Compiled | None]]) -> np.ndarray:
    done, score = _KNOWN.pop(block.name, (0, None))
    if score is None or done > len(pending):
        done, score = 0, block.score.copy()
    for trees in pending[done:]:
        for g, tree in enumerate(trees):
            if tree is not None:
                score[g] += tree.value[tree.leaves(block.codes)]
    _KNOWN[block.name] = (len(pending), score)
    while sum(s.nbytes for _, s in _KNOWN.values()) > _KNOWN_BYTES and len(_KNOWN) > 1:
        _KNOWN.popitem(last=False)
    return score


def _tasks(df: DataFrame, rows: int) -> int:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(-(-rows // ROWS_PER_TASK), max(2 * cores, -(-rows // MOST_ROWS))))


def blocks(df: DataFrame, cuts: Sequence[np.ndarray], goals: Sequence[Goal], rows: int) -> DataFrame:
    """(block binary): `df` has features `x0..`, values `y0..` and parts `p0..`; coded by `cuts`."""
    n_features, n_goals = len(cuts), len(goals)
    bases = [g.base for g in goals]
    tasks = _tasks(df, rows)
    columns = [*[f"x{i}" for i in range(n_features)],
               *[F.col(f"y{g}").cast("double").alias(f"y{g}") for g in range(n_goals)],
               *[F.col(f"p{g}").cast("byte").alias(f"p{g}") for g in range(n_goals)]]

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        column = lambda i: t.column(i).to_numpy()
        codes = np.stack([np.searchsorted(c, column(i), "left").astype(np.uint8) for i, c in enumerate(cuts)])
        y = np.stack([column(n_features + g) for g in range(n_goals)])
        part = np.stack([column(n_features + n_goals + g) for g in range(n_goals)])
        score = np.repeat(np.array(bases)[:, None], t.num_rows, axis=1)
        block = Block(uuid.uuid4().hex, codes, np.where(part < 0, 0.0, y), part, score)
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= MOST_ROWS:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return df.select(*columns).repartition(tasks).mapInArrow(run, "block binary")


def kept(table: DataFrame) -> RDD:
    return table.rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _summed(rdd: RDD, answer: Callable[[Block], list], add: Callable[[list, list], list]) -> list | None:
    """`answer` of every block, added up."""

    def partial(records: Iterator[bytes]) -> Iterator[list]:
        total = None
        for record in records:
            own = answer(pickle.loads(record))
            total = own if total is None else add(total, own)
        if total is not None:
            yield total

    partials = rdd.mapPartitions(partial)
    if rdd.getNumPartitions() > MOST_PARTIALS:
        return partials.treeReduce(add, 2)
    total = None
    for own in partials.collect():
        total = own if total is None else add(total, own)
    return total


def _added(a: list, b: list) -> list:
    return [x if y is None else y if x is None else x + y for x, y in zip(a, b)]


def _slices(cuts: Sequence[np.ndarray], chosen: Sequence[int], goals: int, rdd: RDD) -> list[Codes]:
    """The chosen features in neighbouring slices, each with counts for one task to add up."""
    whole = Codes(cuts, chosen)
    # At most half of the nodes are counted, each code by 32-bit numbers for two sides.
    sent = rdd.getNumPartitions() * goals * 8 * whole.total * (N.TREE_LEAVES + 1) // 2
    n = max(1, min(len(chosen), rdd.context.defaultParallelism, -(-sent // BYTES_PER_SUM)))
    ends = [len(chosen) * i // n for i in range(n + 1)]
    return [Codes(cuts, chosen[a:b]) for a, b in zip(ends, ends[1:])]


def _count(
    rdd: RDD, before: RDD | list | None, pending: list, alphas: Sequence[float], growing: Sequence[int],
    trees: dict[int, list[Node]], counted: dict[int, list[int]], rest: dict[int, list[tuple[int, int, int]]],
    slices: Sequence[Codes], errors: bool, shared: bool, on_driver: bool,
) -> RDD | list:
    """For each slice of the features: validation errors of the goals (in the first, if asked), by goal
    the best split of each open node, in their order, and the rows of each by code and side of the score.

    `before` is what the level above gave; nodes of `rest` are counted as what is left of their parent.
    """
    grown = {g: Compiled(trees[g]) for g in growing}
    place = {}
    for g in growing:
        place[g] = np.full(len(trees[g]), -1, dtype=np.int64)
        place[g][counted[g]] = np.arange(len(counted[g]))

    def answer(block: Block) -> list[list]:
        score = _scores(block, pending)
        out: list[list] = [[] for _ in slices]
        for g in growing:
            part, y = block.part[g], block.y[g]
            if errors:
                val = part == VAL
                out[0].append(np.array([np.abs(y[val] - score[g][val]).sum(), val.sum()]))
            fit = np.flatnonzero(part == FIT)
            node = place[g][grown[g].leaves(block.codes[:, fit])]
            fit, node = fit[node >= 0], node[node >= 0]
            above = y[fit] > score[g][fit]
            for own, codes in zip(out, slices):
                if not codes.chosen:
                    own.append(None)
                    continue
                cell = 2 * (node * codes.total) + above
                code = block.codes[codes.chosen][:, fit].astype(np.int64)
                cells = (cell[None, :] + 2 * (code + codes.first[:-1, None])).ravel()
                sums = np.bincount(cells, minlength=2 * codes.total * len(counted[g]))
                # A block has far fewer rows than a 32-bit number may count.
                own.append(sums.astype(np.int32).reshape(len(counted[g]), codes.total, 2))
        return out

    def add(a: list, b: list) -> list:
        return _added([x if x is None else x.astype(np.float64 if x.ndim == 1 else np.int64) for x in a], b)

    def partial(records: Iterator[bytes]) -> Iterator[tuple]:
        total = None
        for record in records:
            own = answer(pickle.loads(record))
            total = own if total is None else [add(x, y) for x, y in zip(total, own)]
        for i, sums in enumerate(total or []):
            yield i, (False, sums)

    def parents(record: tuple) -> tuple:
        i, (_, _, by_goal) = record
        return i, (True, {g: {p: by_goal[g][p] for _, _, p in rest[g]} for g in growing})

    def split(records: Iterator[tuple]) -> Iterator[tuple]:
        totals, whole = {}, {}
        for i, (is_whole, own) in records:
            if is_whole:
                whole[i] = own
            else:
                totals[i] = add(totals[i], own) if i in totals else own
        for i, total in totals.items():
            step = 2 if errors and i == 0 else 1
            wrong = {g: tuple(total[step * k]) for k, g in enumerate(growing)} if step == 2 else {}
            by_goal, found = {}, {}
            for g, cells in zip(growing, total[step - 1:: step]):
                if cells is not None:
                    by_node = dict(zip(counted[g], cells.astype(np.int64)))
                    by_node |= {node: whole[i][g][parent] - by_node[other] for node, other, parent in rest[g]}
                    by_goal[g] = by_node
                    found[g] = gains(np.stack([by_node[n] for n in sorted(by_node)]), slices[i], alphas[g])
            if shared and found:
                # The slopes of a quantile vary by alpha (1 - alpha), so that is each goal's measure.
                whole_gain = sum(found[g][0] / (alphas[g] * (1 - alphas[g])) for g in found)
                found = {g: (whole_gain, *found[g][1:]) for g in found}
            yield i, (wrong, {g: np.array(best_splits(*found[g], slices[i])) for g in found}, by_goal)

    if on_driver:
        return list(split([*rdd.mapPartitions(partial).collect(), *map(parents, before or [])]))
    dealt = rdd.mapPartitions(partial).partitionBy(len(slices))
    if before is not None:
        dealt = dealt.union(before.map(parents).partitionBy(len(slices)))
    return dealt.mapPartitions(split)


def _grow(
    rdd: RDD, pending: list, goals: Sequence[Goal], growing: Sequence[int], slices: Sequence[Codes], depth: int,
    shared: bool, on_driver: bool,
) -> tuple[dict[int, list[Node]], dict[int, tuple[float, int]]]:
    """A tree without leaf values for each goal, all level by level, and the errors before them."""
    alphas = [goal.alpha for goal in goals]
    trees = {g: [LEAF] for g in growing}
    counted: dict[int, list[int]] = {g: [0] for g in growing}
    # Of two children the smaller one is counted, the other is what is left of their parent.
    rest: dict[int, list[tuple[int, int, int]]] = {g: [] for g in growing}
    errors: dict[int, tuple[float, int]] = {}
    sums = None
    for level in range(max(depth, 1)):
        active = list(growing) if level == 0 else [g for g in growing if counted[g]]
        if not active:
            break
        sums = _count(rdd, sums, pending, alphas, active, trees, dict(counted), dict(rest), slices, level == 0,
                      shared, on_driver)
        small_part = lambda r: (r[0], *r[1][:2])
        found = sorted(map(small_part, sums) if on_driver else sums.map(small_part).collect(), key=lambda r: r[0])
        errors = found[0][1] if level == 0 and found else errors
        for g in active:
            nodes = sorted([*counted[g], *(node for node, _, _ in rest[g])])
            counted[g], rest[g] = [], []
            bests = [best[g] for _, _, best in found if g in best]
            if not bests:
                continue
            # Of equal gains the first feature counts, as within a slice.
            first = np.argmax([b[:, 0] for b in bests], axis=0)
            best = [bests[i][k] for k, i in enumerate(first)]
            if depth > 0:
                counted[g], rest[g] = opened(trees[g], best, nodes)
    if sums is not None and not on_driver:
        forget(sums)
    return trees, errors


def _summary(values: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` values that stand for equal shares of the weight; all of them if they are few."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if len(values) <= most:
        return values, weights
    upto = np.cumsum(weights)
    at = np.searchsorted(upto, (np.arange(most) + 0.5) * upto[-1] / most)
    return values[at], np.full(most, upto[-1] / most)


def _at(values: np.ndarray, weights: np.ndarray, rank: float) -> float:
    return float(values[min(np.searchsorted(np.cumsum(weights), rank), len(values) - 1)])


def _quantile(values: np.ndarray, weights: np.ndarray, alpha: float) -> float:
    return _at(values, weights, rank_of(alpha, np.cumsum(weights)[-1]))


def _residuals(
    rdd: RDD, pending: list, trees: dict[int, list[Node]], most: int, tasks: int, on_driver: bool,
    between: dict[tuple[int, int], tuple[float, float]], found: Callable,
) -> dict[tuple[int, int], object]:
    """What `found` tells by goal and leaf of: the goal, rows of the leaf, residuals less than all of a
    range (`between`, else all of them are in it), and the values and weights of those in the range.

    Up to `most` rows of a leaf and block go as they are. Of more, as many values go as `most` for all
    of the leaf make for its range, so a rank is off by at most half a row in `most`.
    """
    grown = {g: Compiled(tree) for g, tree in trees.items()}

    def partial(records: Iterator[bytes]) -> Iterator[tuple]:
        for record in records:
            block = pickle.loads(record)
            score = _scores(block, pending)
            for g, tree in grown.items():
                fit = block.part[g] == FIT
                leaf = tree.leaves(block.codes[:, fit])
                residual = (block.y[g] - score[g])[fit]
                order = np.argsort(leaf, kind="stable")
                leaf, residual = leaf[order], residual[order]
                each, first = np.unique(leaf, return_index=True)
                for n, r in zip(each.tolist(), np.split(residual, first[1:])):
                    low, high = between.get((g, n), (-math.inf, math.inf))
                    inside = r[(r >= low) & (r <= high)]
                    points = -(-most * len(inside) // len(r))
                    yield (g, n), (len(r), int((r < low).sum()), *_summary(*np.unique(inside, return_counts=True), points))

    def gathered(records: Iterator[tuple]) -> Iterator[tuple]:
        by_leaf: dict = {}
        for key, own in records:
            by_leaf.setdefault(key, []).append(own)
        for key, owns in by_leaf.items():
            rows, below, values, weights = zip(*owns)
            values, weights = np.concatenate(values), np.concatenate(weights)
            order = np.argsort(values, kind="stable")
            yield key, found(key[0], sum(rows), sum(below), values[order], weights[order])

    if on_driver:
        return dict(gathered(rdd.mapPartitions(partial).collect()))
    dealt = rdd.mapPartitions(partial).partitionBy(tasks).mapPartitions(gathered)
    out = dict(dealt.collect())
    forget(dealt)
    return out


def _valued(
    rdd: RDD, pending: list, goals: Sequence[Goal], trees: dict[int, list[Node]], learning_rate: float, accuracy: int,
    rows: int, on_driver: bool,
) -> dict[int, list[Node]]:
    """The trees with the quantile of the residuals in each leaf, times the learning rate.

    The quantiles are exact to one in `accuracy` rows, and to the row in leaves of
    at most `accuracy` / 2 rows a block.
    """
    alphas = {g: goals[g].alpha for g in trees}
    most = max(accuracy // 2, 2)
    blocks_ = max(rdd.getNumPartitions(), -(-rows // MOST_ROWS))

    def ends(g: int, n: int, below: int, values: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
        # Ranks by these values are off by half of what is left to both sides.
        low, high = (rank_of(alphas[g], n) + side * n / PROBES for side in (-1, 1))
        return (_at(values, weights, low) if low > 0 else -math.inf, _at(values, weights, high) if high < n else math.inf)

    def value(g: int, n: int, below: int, values: np.ndarray, weights: np.ndarray) -> float:
        return _at(values, weights, rank_of(alphas[g], n) - below)

    between, sent = {}, 16 * min(rows, blocks_ * N.TREE_LEAVES * most) * len(trees)
    if rows * len(trees) > ONE_PASS_ROWS:
        between = _residuals(rdd, pending, trees, PROBES, 1, on_driver, {}, ends)
        sent = sent * 4 // PROBES
    tasks = max(1, min(rdd.context.defaultParallelism, -(-sent // BYTES_PER_SUM)))
    values = _residuals(rdd, pending, trees, most, tasks, on_driver, between, value)
    return {g: [replace(n, value=learning_rate * values.get((g, i), 0.0)) if n.feature < 0 else n
                for i, n in enumerate(trees[g])] for g in sorted(trees)}


def _rescored(pending: list) -> Callable:
    def run(record: bytes) -> tuple[bytes]:
        block = pickle.loads(record)
        score = _scores(block, pending)
        return (pickle.dumps(replace(block, name=uuid.uuid4().hex, score=score)),)

    return run


def boost(
    df: DataFrame, cuts: Sequence[np.ndarray], usable: Sequence[int], goals: Sequence[Goal], rows: int, *,
    rounds: int, learning_rate: float, patience: int, depth: int, feature_fraction: float, accuracy: int, seed: int,
    shared: bool = False,
) -> None:
    """Grow the trees of all goals, at most `rounds`, in place; each goal stops on its own.

    Up to `rounds.MOST_ROWS` rows, a task goes through all rounds of a goal. Of more, a round is one pass
    for each level of the trees and one or two for their values, whatever the number of goals, and every `ROUNDS_PER_TABLE` rounds the blocks are written with their scores and the table before is
    deleted. Each goal keeps its best run of trees by validation error, then gets its errors. `shared`
    goals, quantiles of one value on the same rows, split alike, where all that still grow gain most
    together, and differ in the values of their leaves.
    """
    spark = df.sparkSession
    # Counts of all nodes that are counted in a round, and a value and a weight for each row.
    a_round = _tasks(df, rows) * 8 * Codes(cuts, usable).total * (N.TREE_LEAVES + 1) // 2 + 16 * rows
    on_driver = rounds * len(goals) * a_round <= DRIVER_BYTES
    if not on_driver and rows <= rounds_.MOST_ROWS:
        rounds_.boost_in_tasks(df, cuts, usable, goals, rounds=rounds, learning_rate=learning_rate, patience=patience,
                               depth=depth, feature_fraction=feature_fraction, seed=seed, shared=shared)
        return
    table = settle(blocks(df, cuts, goals, rows))
    first, rdd = table, kept(table)
    picker = random.Random(seed)
    take = max(1, round(len(usable) * feature_fraction))
    pending: list[list[Compiled | None]] = []
    for done in range(rounds + 1):
        growing = [g for g, goal in enumerate(goals) if goal.growing]
        chosen = sorted(picker.sample(list(usable), take)) if done < rounds else []
        slices = _slices(cuts, chosen, len(growing), rdd)
        trees, errors = _grow(rdd, pending, goals, growing, slices, depth if chosen else 0, shared, on_driver)
        for g in growing:
            goal, (wrong, n) = goals[g], errors.get(g, (0.0, 0))
            goal.seen(wrong / n if n else math.inf, done, patience)
        trees = {g: t for g, t in trees.items() if goals[g].growing}
        if done == rounds or not trees:
            break
        trees = _valued(rdd, pending, goals, trees, learning_rate, accuracy, rows, on_driver)
        for g, tree in trees.items():
            goals[g].trees.append(tree)
        pending.append([Compiled(trees[g]) if g in trees else None for g in range(len(goals))])
        if len(pending) == ROUNDS_PER_TABLE:
            written = settle(spark.createDataFrame(rdd.map(_rescored(pending)), "block binary"))
            rdd.unpersist()
            if table is not first:
                discard(table)
            table, rdd, pending = written, kept(written), []
    rdd.unpersist()
    if table is not first:
        discard(table)
    for goal in goals:
        goal.trees = goal.trees[: max(1, goal.best_size)]
    _measure(kept(first), goals)
    discard(first)


def _measure(rdd: RDD, goals: Sequence[Goal]) -> None:
    """Mean absolute errors of the finished models on the validation and test rows."""
    finished = [[Compiled(t) for t in goal.trees] for goal in goals]

    def answer(block: Block) -> list:
        out = []
        for g, trees in enumerate(finished):
            score = block.score[g].copy()
            for tree in trees:
                score += tree.value[tree.leaves(block.codes)]
            wrong = np.abs(block.y[g] - score)
            out.append(np.array([f(wrong, block.part[g] == p) for p in (VAL, TEST)
                                 for f in (lambda w, m: w[m].sum(), lambda w, m: m.sum())]))
        return out

    total = _summed(rdd, answer, _added)
    rdd.unpersist()
    for goal, sums in zip(goals, total or []):
        goal.mae_validation = float(sums[0] / sums[1]) if sums[1] else None
        goal.mae = float(sums[2] / sums[3]) if sums[3] else None


def plain(node: Node, cuts: Sequence[np.ndarray]) -> Node:
    """The node with the cut itself for the cut's number."""
    return node if node.feature < 0 else replace(node, threshold=float(cuts[node.feature][int(node.threshold)]))
