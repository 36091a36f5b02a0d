"""Merges of all runs of exons equal the naive method's."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.operators import linkage, tree
from locusweave.plans.queries import QUERIES, blocks

from .test_tree import single_linkage

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_all_blocks_are_linked(spark):
    places = defaultdict(list)
    for r in blocks(spark, DIR).collect():
        places[r.block, r.g1chr, r.g2chr].append((r.g1start, r.g1end, r.g2start, r.g2end))
    assert any(block % 5 for block, *_ in places)
    heights = {k: single_linkage(v) for k, v in places.items()}
    want = {(*k, h): sum(d <= h for d in of) for k, of in heights.items() for h in (100, 300, 1000)}
    rows = QUERIES["block_linkage"](spark, DIR).collect()
    assert len(rows) == len(want) and {(r.block, r.g1chr, r.g2chr, r.height): r.merges for r in rows} == want


def test_a_call_of_python_holds_many_small_tiles(spark, monkeypatch):
    """Pairs of a few hits don't cost a call each, and have the trees that they have alone."""
    rng = random.Random(3)
    rows = [(f"b{pair}", "y", leaf, a := rng.randrange(4000), a + 20, b := rng.randrange(4000), b + 20) for pair in range(1500) for leaf in range(1 + pair % 4)]
    leaves = spark.createDataFrame(rows, "g1chr string, g2chr string, leaf long, g1start long, g1end long, g2start long, g2end long")
    calls, dealt = [], linkage._called
    monkeypatch.setattr(linkage, "_called", lambda *x: calls.append(dealt(*x)) or calls[-1])
    found = {}
    for r in linkage.linkage(leaves).collect():
        found.setdefault(r.g1chr, set()).add((r.i, r.j, r.height))
    assert 0 < calls[0].agg(F.count("*")).count() <= 64
    for pair in range(1500):
        own = [r for r in rows if r[0] == f"b{pair}"]
        i, j, h = tree.spanning_tree(np.array([r[3:] for r in own]))
        assert found.get(f"b{pair}", set()) == set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), h.tolist(), strict=True))


def test_few_tiles_meet_where_some_have_hits_far_away(spark, monkeypatch):
    """Hits far from a diagonal are parts of their own: their tiles don't meet all others, and the tree is the same."""
    rng = random.Random(5)
    rows = [("x", "y", k, a := 100 * k, a + 20, b := (a + rng.randrange(50) if k % 50 else 1_000_000 + rng.randrange(5000)), b + 20) for k in range(4000)]
    leaves = spark.createDataFrame(rows, "g1chr string, g2chr string, leaf long, g1start long, g1end long, g2start long, g2end long")
    met, write = [], linkage.written
    monkeypatch.setattr(linkage, "written", lambda df, name: write(df, name) if name != "met" else met.append(write(df, name)) or met[0])
    found = linkage.linkage(leaves, 64).toPandas()
    assert not found.duplicated(["i", "j"]).any()
    i, j, h = tree.spanning_tree(np.array([r[3:] for r in rows]))
    assert set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), h.tolist(), strict=True)) <= set(found[["i", "j", "height"]].itertuples(index=False, name=None))
    assert met[0].count() / 2 < 5 * 4000 / 64


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 301])
def test_trees_side_by_side_are_those_of_each_tile(n):
    rng = np.random.default_rng(n)
    starts = rng.integers(0, 500, (5, n, 2))
    places = np.stack([starts[..., 0], starts[..., 0] + rng.integers(-9, 60, (5, n)), starts[..., 1], starts[..., 1] + rng.integers(-9, 60, (5, n))], 2)
    for tile, *found in zip(places, *linkage.spanning_trees(places), strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(linkage.spanning_tree(tile), found, strict=True))
