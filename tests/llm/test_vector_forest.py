"""Copies of a vector over the leaves of the forest, and pairs at the threshold that no tree keeps together."""

import numpy as np

from notelake.llm import embedding_dedup as ed


def placed(trees, unit):
    made = [set() for _ in unit]
    for tree in trees:
        for vector, leaf in zip(*(x.tolist() for x in tree.place(unit)), strict=True):
            made[vector].add(leaf)
    return made


def test_copies_hardly_grow_with_the_table_and_threshold_pairs_meet():
    rng = np.random.default_rng(1)
    unit = ed._unit(rng.standard_normal((20_000, 64)))
    copies = {}
    for total in (20_000, 640_000):
        trees = ed.forest(unit, ed.LEAF * len(unit) / total, 0.98)
        own = unit[:3_000]
        away = rng.standard_normal(own.shape)
        away = ed._unit(away - (away * own).sum(axis=1, keepdims=True) * own)
        mine, near = placed(trees, own), placed(trees, 0.98 * own + np.sqrt(1 - 0.98**2) * away)
        assert all(a & b for a, b in zip(mine, near, strict=True))
        copies[total] = np.mean([len(x) for x in mine])
    assert copies[640_000] < 20 and copies[640_000] < 3 * copies[20_000], copies


def test_dense_clusters_stay_in_one_leaf():
    """A split through a group of near copies would part many of its pairs."""
    rng = np.random.default_rng(2)
    unit = ed._unit(rng.standard_normal(64) + 0.05 * rng.standard_normal((4_000, 64)))
    assert [tree.leaves for tree in ed.forest(unit, 500, 0.98)] == [1]
