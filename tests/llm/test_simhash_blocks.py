"""Choices of bit blocks: every pair within the radius meets, whatever the blocks and tiles."""

from itertools import combinations

import numpy as np
import pytest

from barsignals.llm import simhash


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def joined(spark, values, **how):
    """Class of each value by the edges of ``links``."""
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), 3, **how).collect()
    root = {signed(v): signed(v) for v in values}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for e in edges:
        a, b = sorted((find(e["u"]), find(e["v"])))
        root[b] = a
    return [find(signed(v)) for v in values]


def plain(values):
    root = list(range(len(values)))
    for i, j in combinations(range(len(values)), 2):
        if bin(values[i] ^ values[j]).count("1") <= 3:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    least = {}
    for r, v in zip(root, values):
        least[r] = min(least.get(r, signed(v)), signed(v))
    return [least[r] for r in root]


@pytest.mark.parametrize("blocks", [4, 5, 6, 9])
def test_choices_cover_every_three_bits(blocks):
    masks = [m % (1 << 64) for m in simhash._masks(3, blocks)]
    assert len(masks) == len(set(masks)) == len(list(combinations(range(blocks), 3)))
    rng = np.random.default_rng(blocks)
    for bits in [(0, 31, 63), (61, 62, 63), *rng.integers(0, 64, (2000, 3)).tolist()]:
        flipped = sum({1 << int(b) for b in bits})
        assert any(m & flipped == 0 for m in masks)


@pytest.mark.parametrize("blocks, tile", [(4, 1024), (None, 1024), (None, 5), (6, 1024), (6, 7)])
def test_classes_whatever_the_blocks(spark, blocks, tile):
    rng = np.random.default_rng(7)
    values = set()
    for _ in range(40):  # pairs and chains apart, with differing bits anywhere
        v = int(rng.integers(1 << 63)) * 2 + 1
        for _ in range(int(rng.integers(1, 5))):
            values.add(v)
            v ^= sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5))})
    base = int(rng.integers(1 << 62))  # one hot group: the upper half of all these is equal
    values |= {base ^ int(x) for x in rng.integers(0, 1 << 20, 150)} | {0, (1 << 64) - 1, 7, 15}
    values = sorted(values)
    assert joined(spark, values, tile=tile, blocks=blocks) == plain(values)


def test_a_hot_value_is_cut_into_tiles(spark, monkeypatch):
    """Values that agree in more than two blocks meet in tiles, no group of which exceeds what was stated."""
    seen = []
    kept = simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: seen.append((name, kept(df, name))) or seen[-1][1])
    values = [(5 << 40) + k for k in range(400)]
    simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, 16).collect()
    tiles = dict(seen)["simhash-tiles"].selectExpr("size(fps) AS n").collect()
    assert max(r["n"] for r in tiles) <= 4 * 16
