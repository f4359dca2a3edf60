"""The walk over flat trees against the plain version, leaf by leaf."""

import time

import numpy as np
import pytest

from riskfold.operators import treepaths
from riskfold.operators.treepaths import Tree
from tests import plain_trees


def random_tree(rng, depth, slots, stop=0.15):
    """Features come again on a path; some splits list categories."""
    left, right, slot, threshold, categories, value, cover = [], [], [], [], {}, [], []

    def grow(d, rows):
        at = len(left)
        for held, v in ((left, -1), (right, -1), (slot, -1), (threshold, np.nan), (value, rng.uniform()), (cover, rows)):
            held.append(v)
        if d < depth and rows > 3 and rng.uniform() > stop:
            slot[at] = int(rng.integers(slots))
            if slot[at] == 0:
                categories[at] = tuple(float(v) for v in rng.permutation(4)[: rng.integers(1, 4)])
            else:
                threshold[at] = float(rng.uniform())
            part = float(rng.integers(1, int(rows)))
            left[at] = grow(d + 1, part)
            right[at] = grow(d + 1, rows - part)
        return at

    grow(0, 1000.0 if depth < 9 else 1e9)
    return Tree(*map(np.array, (left, right, slot, threshold)), categories, np.array(value), np.array(cover))


def plain(trees, x, width):
    leaves = (leaf for t in trees for leaf in plain_trees.tree_leaves(t, len(trees)))
    parts, base = plain_trees.forest_contributions(leaves, x)
    out = np.zeros((len(x), width))
    for slot, v in parts.items():
        out[:, slot] = v
    return out, base


def rows_of(rng, n, slots):
    x = rng.uniform(size=(n, slots))
    x[:, 0] = rng.integers(0, 4, n)
    return x


@pytest.mark.parametrize("group", [1, 60, 100_000])
def test_walk_equals_leaf_by_leaf(group, monkeypatch):
    monkeypatch.setattr(treepaths, "CELLS", 5000)  # several slices of rows
    rng = np.random.default_rng(8)
    for depth, slots in ((0, 3), (1, 2), (4, 3), (7, 12), (12, 4)):
        trees = [random_tree(rng, depth, slots) for _ in range(6)]
        x = rows_of(rng, 80, slots)
        x[3, 1] = np.nan  # goes right, as in scoring
        found, base = treepaths.contributions(treepaths.walks(trees, len(trees), group), x, slots)
        want, want_base = plain(trees, x, slots)
        assert base == pytest.approx(want_base) and np.allclose(found, want, atol=1e-10)


def test_ten_times_faster_on_deep_forests():
    rng = np.random.default_rng(9)
    trees = [random_tree(rng, 10, 30, stop=0.0) for _ in range(100)]
    x = rows_of(rng, 256, 30)
    forest = treepaths.walks(trees, len(trees))
    started = time.perf_counter()
    found, _ = treepaths.contributions(forest, x, 30)
    walk = time.perf_counter() - started
    started = time.perf_counter()
    want, _ = plain(trees[:3], x, 30)
    leaves = (time.perf_counter() - started) * len(trees) / 3
    some, _ = treepaths.contributions(treepaths.walks(trees[:3], 3), x, 30)
    assert np.allclose(some, want, atol=1e-10) and found.shape == (256, 30)
    assert leaves > 10 * walk, (leaves, walk)
