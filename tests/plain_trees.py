"""Tree contributions leaf by leaf: the plain version that the library's walk is held against."""

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np

from riskfold.operators.treepaths import Tree, forest_trees


@dataclass(frozen=True)
class Split:
    """All conditions one path puts on one feature, and the share of rows that meet them."""

    slot: int
    tests: tuple[tuple[float | tuple[float, ...], bool], ...]  # threshold or categories, side
    share: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for rule, left in self.tests:
            goes_left = np.isin(x, rule) if isinstance(rule, tuple) else x <= rule
            out &= goes_left == left
        return out


Leaf = tuple[float, tuple[Split, ...]]


def tree_leaves(tree: Tree, trees: int = 1) -> Iterator[Leaf]:
    """Class-1 value, divided by the number of trees, and path of every leaf of one tree."""
    stack = [(0, ())]
    while stack:
        at, path = stack.pop()
        if tree.left[at] < 0:
            yield float(tree.value[at]) / trees, _by_feature(path)
            continue
        rule = tree.categories.get(at, float(tree.threshold[at]))
        for child, left in ((tree.left[at], True), (tree.right[at], False)):
            share = float(tree.cover[child] / tree.cover[at])
            stack.append((int(child), (*path, (int(tree.slot[at]), rule, left, share))))


def forest_leaves(model, spark) -> list[Leaf]:
    """The leaves of all trees, for a small forest."""
    n = model.getNumTrees
    return [leaf for tree in forest_trees(model, spark) for leaf in tree_leaves(tree, n)]


def _by_feature(path: Sequence[tuple]) -> tuple[Split, ...]:
    merged: dict[int, tuple[list, float]] = {}
    for slot, rule, left, share in path:
        tests, so_far = merged.get(slot, ([], 1.0))
        merged[slot] = ([*tests, (rule, left)], so_far * share)
    return tuple(Split(s, tuple(t), share) for s, (t, share) in merged.items())


def leaf_contributions(leaf: Leaf, x: np.ndarray) -> dict[int, np.ndarray]:
    """Path-dependent Shapley values of one leaf for a block of rows, per feature slot.

    With features outside a coalition replaced by the share of training rows that pass,
    the leaf is worth the product of one factor per feature. The coalitions of one size
    are the coefficients of a product of linear terms.
    """
    value, splits = leaf
    m = len(splits)
    met = [s.holds(x[:, s.slot]).astype(float) for s in splits]
    out = {}
    for i, own in enumerate(splits):
        sizes = [np.ones(len(x))]  # sizes[k]: sum over coalitions of k other features
        for j, other in enumerate(splits):
            if j == i:
                continue
            grown = [c * other.share for c in sizes] + [np.zeros(len(x))]
            for k, c in enumerate(sizes):
                grown[k + 1] = grown[k + 1] + c * met[j]
            sizes = grown
        total = sum(
            c * (factorial(k) * factorial(m - k - 1) / factorial(m)) for k, c in enumerate(sizes)
        )
        out[own.slot] = value * (met[i] - own.share) * total
    return out


def forest_contributions(leaves: Iterable[Leaf], x: np.ndarray) -> tuple[dict[int, np.ndarray], float]:
    """Contribution per used feature slot for a block of rows, and the base value."""
    total: dict[int, np.ndarray] = {}
    base = 0.0
    for leaf in leaves:
        base += leaf[0] * float(np.prod([s.share for s in leaf[1]]))
        for slot, part in leaf_contributions(leaf, x).items():
            total[slot] = total[slot] + part if slot in total else part
    return total, base
