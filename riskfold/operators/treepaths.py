"""Shapley values of tree ensembles, path-dependent, by one walk down and up all trees at once.

With features outside a coalition replaced by the share of training rows that pass, a leaf is
worth the product of one factor per feature on its path: the share z, or o, which is 1 if the row
meets all of the path's tests on the feature. The weights of coalitions by size are integrals
of powers of t and 1 - t, so a feature's contribution at a leaf is the leaf's value times

    (o - z) * integral over t of the product of the other features' z (1 - t) + o t

which Gauss-Legendre nodes integrate exactly: half as many as features on a path. Going down, an
edge extends the product by its factor, after taking out that of the last edge on the same
feature; going up, leaves are summed, and each edge unwinds its own factor by a division. This
costs leaves times depth times nodes instead of leaves times depth cubed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskfold.functions.scaling import shared_dir

GROUP_NODES = 2048  # of the trees that are walked together
CELLS = 1 << 17  # nodes times rows of one walk


@dataclass(frozen=True)
class Tree:
    """Nodes of one tree as flat arrays in node order; ``left`` is negative at a leaf."""

    left: np.ndarray
    right: np.ndarray
    slot: np.ndarray
    threshold: np.ndarray
    categories: dict[int, tuple[float, ...]]  # by node, those that go left
    value: np.ndarray
    cover: np.ndarray


def forest_trees(model: RandomForestClassificationModel, spark: SparkSession) -> Iterator[Tree]:
    """The trees of a forest, one at a time, read from the node table of the saved model."""
    path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    node = F.struct(
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split").alias("split"),
        F.col("nodeData.impurityStats").alias("stats"),
    )
    saved = spark.read.parquet(f"{path}/data")
    trees = saved.groupBy("treeID").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    for row in trees.toLocalIterator():
        yield _flat(row.nodes)


def _flat(nodes: Sequence) -> Tree:
    stats = np.array([n.stats for n in nodes], dtype=float)
    cover = stats.sum(axis=1)
    inner = [n.left >= 0 for n in nodes]
    listed = [i and n.split.numCategories >= 0 for i, n in zip(inner, nodes)]
    return Tree(
        np.array([n.left for n in nodes]),
        np.array([n.right for n in nodes]),
        np.array([n.split.featureIndex if i else -1 for i, n in zip(inner, nodes)]),
        np.array(
            [
                n.split.leftCategoriesOrThreshold[0] if i and not c else np.nan
                for i, c, n in zip(inner, listed, nodes)
            ]
        ),
        {k: tuple(nodes[k].split.leftCategoriesOrThreshold) for k, c in enumerate(listed) if c},
        stats[:, 1] / cover,
        cover,
    )


@dataclass(frozen=True)
class Walk:
    """Some trees as flat arrays level by level; the children of a node are neighbours.

    Row 0 stands for "no edge": roots have it as their edge's predecessor. ``same`` is the last edge
    above on the same feature, or 0; ``share`` is the product of shares of all such edges.
    """

    levels: tuple[tuple[int, int], ...]  # first and last place of each level, roots first
    parent: np.ndarray
    same: np.ndarray
    slot: np.ndarray
    left: np.ndarray
    threshold: np.ndarray
    categories: dict[int, tuple[float, ...]]
    share: np.ndarray
    value: np.ndarray  # of leaves, divided by the number of trees
    base: float
    longest: int  # features on a path

    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Used slots, and their contributions to each row of ``x`` (slots x rows)."""
        columns = x.T
        o = columns[self.slot] <= self.threshold[:, None]
        for at, listed in self.categories.items():
            o[at] = np.isin(columns[self.slot[at]], listed)
        o ^= ~self.left[:, None]
        o[: self.levels[0][1]] = True  # no edge leads to a root
        for a, b in self.levels[1:]:
            o[a:b] &= o[self.same[a:b]]
        # An edge's factor and its predecessor's have three cases: neither is met, the one
        # above is, both are. So all that depends on t is looked up by edge and case.
        case = o.astype(np.intp)
        case += case[self.same]
        case += 3 * np.arange(len(o))[:, None]
        z, z_above = self.share[:, None], self.share[self.same][:, None]
        met, met_above = np.array([0, 0, 1]), np.array([0, 1, 1])
        points, weights = np.polynomial.legendre.leggauss(max(1, -(-self.longest // 2)))
        total, product, own = np.zeros(o.shape), np.empty(o.shape), np.empty(o.shape)
        for t, weight in zip((points + 1) / 2, weights / 2):
            factor, above = z * (1 - t) + met * t, z_above * (1 - t) + met_above * t
            np.take((factor / above).ravel(), case, out=product, mode="clip")
            product[: self.levels[0][1]] = 1
            for a, b in self.levels[1:]:
                product[a:b] *= product[self.parent[a:b]]
            product *= self.value[:, None]
            for a, b in self.levels[:0:-1]:
                product[self.parent[a:b:2]] = product[a:b:2] + product[a + 1 : b : 2]
            gain = (met - z) / factor - (met_above - z_above) / above
            np.take((weight * gain).ravel(), case, out=own, mode="clip")
            own *= product
            total += own
        edges = np.arange(self.levels[0][1], len(self.slot))
        order = edges[np.argsort(self.slot[edges], kind="stable")]
        slots, starts = np.unique(self.slot[order], return_index=True)
        if not len(slots):  # a tree without a split
            return slots, np.zeros((0, x.shape[0]))
        return slots, np.add.reduceat(total[order], starts)


def walk_of(trees: Sequence[Tree], n_trees: int) -> Walk:
    """Trees that are walked together, of an ensemble of ``n_trees``."""
    rows = [(0, 0, 0, True, np.inf, None, 1.0, 0.0)]  # no edge
    levels, base, longest, above = [], 0.0, 0, []
    for tree in trees:
        rows.append((0, 0, 0, True, np.inf, None, 1.0, float(tree.value[0]) / n_trees))
        leaf = tree.left < 0
        base += float(tree.value[leaf] @ tree.cover[leaf]) / float(tree.cover[0]) / n_trees
        above.append((len(rows) - 1, tree, 0, {}))  # place, tree, node, last edge of each slot
    levels.append((0, len(rows)))
    while above:
        first, below = len(rows), []
        for at, tree, node, last in above:
            if tree.left[node] < 0:
                continue
            slot, rule = int(tree.slot[node]), tree.categories.get(node)
            same = last.get(slot, 0)
            for child, left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
                share = float(tree.cover[child] / tree.cover[node]) * rows[same][6]
                value = float(tree.value[child]) / n_trees if tree.left[child] < 0 else 0.0
                rows.append((at, same, slot, left, float(tree.threshold[node]), rule, share, value))
                mine = {**last, slot: len(rows) - 1}
                longest = max(longest, len(mine))
                below.append((len(rows) - 1, tree, child, mine))
            rows[at] = (*rows[at][:7], 0.0)
        if len(rows) > first:
            levels.append((first, len(rows)))
        above = below
    parent, same, slot, left, threshold, rules, share, value = zip(*rows)
    return Walk(
        tuple(levels),
        np.array(parent),
        np.array(same),
        np.array(slot),
        np.array(left),
        np.array(threshold),
        {k: r for k, r in enumerate(rules) if r is not None},
        np.array(share),
        np.array(value),
        base,
        longest,
    )


def walks(trees: Iterable[Tree], n_trees: int, group: int = GROUP_NODES) -> list[Walk]:
    """All trees of an ensemble in groups of about ``group`` nodes."""
    out, held, nodes = [], [], 0
    for tree in trees:
        if held and nodes + len(tree.left) > group:
            out.append(walk_of(held, n_trees))
            held, nodes = [], 0
        held.append(tree)
        nodes += len(tree.left)
    return [*out, walk_of(held, n_trees)] if held else out


def contributions(forest: Sequence[Walk], x: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Contribution of each of ``width`` slots to each row of ``x``, and the base value."""
    out = np.zeros((len(x), width))
    for walk in forest:
        step = max(1, CELLS // len(walk.slot))
        for a in range(0, len(x), step):
            slots, parts = walk.contributions(x[a : a + step])
            out[a : a + step, slots] += parts.T
    return out, sum(w.base for w in forest)
