"""Nodes, goals and splits: what growing a tree takes, whoever counts the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from gaugeline import names as N

LEAST_ROWS = 20
FIT, VAL, TEST = range(3)


@dataclass(frozen=True)
class Node:
    """A split (`feature <= threshold` goes left) or, with feature -1, a leaf with a value."""

    feature: int
    threshold: float
    left: int
    right: int
    value: float


LEAF = Node(-1, 0.0, -1, -1, 0.0)


@dataclass
class Goal:
    """What one model learns, and how far it has come. In training a node's threshold is a cut's number."""

    alpha: float
    base: float
    trees: list[list[Node]] = field(default_factory=list)
    best_error: float = math.inf
    best_size: int = 0
    growing: bool = True
    mae: float | None = None
    mae_validation: float | None = None

    def seen(self, error: float, done: int, patience: int) -> None:
        """Note the validation error after `done` trees; stop once it has not improved for long."""
        # Sums of other orders of the rows differ in the last digits.
        if error < self.best_error * (1 - 1e-12):
            self.best_error, self.best_size = error, done
        elif done - self.best_size >= patience:
            self.growing = False


class Codes:
    """Where the codes of each chosen feature begin in one row of counts."""

    def __init__(self, cuts: Sequence[np.ndarray], chosen: Sequence[int]):
        self.sizes = [len(cuts[f]) + 1 for f in chosen]
        self.chosen = list(chosen)
        self.first = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.total = int(self.first[-1])


def gains(cells: np.ndarray, codes: Codes, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node and cut the gain of splitting there, and the rows on both sides."""
    begin = codes.first[:-1].repeat(codes.sizes)
    end = codes.first[1:].repeat(codes.sizes) - 1
    upto = np.cumsum(cells.astype(np.int64), axis=1)
    upto = np.concatenate([np.zeros_like(upto[:, :1]), upto], axis=1)
    left = upto[:, 1:] - upto[:, begin]
    nl, above = left.sum(axis=2), left[:, :, 1]
    sl = above - (1 - alpha) * nl
    n, slope = nl[:, end], sl[:, end]
    nr, sr = n - nl, slope - sl
    gain = sl ** 2 / np.maximum(nl, 1) + sr ** 2 / np.maximum(nr, 1) - slope ** 2 / np.maximum(n, 1)
    return np.where((nl >= LEAST_ROWS) & (nr >= LEAST_ROWS), gain, 0.0), nl, nr


def best_splits(
    gain: np.ndarray, nl: np.ndarray, nr: np.ndarray, codes: Codes
) -> list[tuple[float, int, int, int, int]]:
    """Gain, feature, cut and rows on both sides of the best split of each node; feature -1 if none."""
    out = []
    for node, k in enumerate(gain.argmax(axis=1).tolist()):
        i = int(np.searchsorted(codes.first, k, "right")) - 1
        found = gain[node, k] > 1e-9
        out.append((float(gain[node, k]), codes.chosen[i] if found else -1, k - int(codes.first[i]),
                    int(nl[node, k]), int(nr[node, k])))
    return out


def opened(
    tree: list[Node], best: Sequence[Sequence[float]], nodes: Sequence[int]
) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Split `nodes` of the tree, the best first, while leaves are left to give.

    Of two children the smaller one is to be counted, the other is what is left of their parent:
    the smaller ones, and (other, smaller, parent).
    """
    counted, rest = [], []
    splits = [(b, node) for b, node in zip(best, nodes) if b[1] >= 0]
    for (_, f, k, nl, nr), node in sorted(splits, key=lambda s: (-s[0][0], s[1])):
        # A tree of so many nodes has half of them as leaves.
        if (len(tree) + 1) // 2 < N.TREE_LEAVES:
            left = len(tree)
            tree += [LEAF, LEAF]
            tree[node] = Node(int(f), float(k), left, left + 1, 0.0)
            small, large = (left, left + 1) if nl <= nr else (left + 1, left)
            counted.append(small)
            rest.append((large, small, node))
    return counted, rest


def rank_of(alpha: float, rows: float) -> float:
    return alpha * rows * (1 - 1e-12)
