import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from locusweave import storage
from locusweave.operators import hits, linkage, testing, tracks, tree

EXONS = "exonid string, proteinid string, genome string, seqid string, start long, end long, strand string"
HITS = "qseqid string, sseqid string, K double, g1chr string, g1start long, g1end long, g2chr string, g2start long, g2end long, row_idx long"


def distance(a, b):
    return sum(max(0, max(a[k], b[k]) - min(a[k + 1], b[k + 1])) for k in (0, 2))


def single_linkage(places):
    """Heights of the naive method: join the two nearest groups, again and again."""
    groups, heights = [[p] for p in places], []
    while len(groups) > 1:
        d, i, j = min((min(distance(x, y) for x in a for y in b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        heights.append(d)
        groups[i] += groups.pop(j)
    return heights


def genome(rng, n=26, inverted=False):
    """Exons of both genomes, and hits among them."""
    exons, rows = [], []
    for g in (1, 2):
        for k in range(40):
            exons.append((f"g{g}e{k}", f"g{g}p{k // 3}", f"genome_{g}", f"c{k % 2}", k * 100, k * 100 + rng.choice([0, 30, 60, 150]), "+"))
    at = {e[0]: e for e in exons}
    for i in range(n):
        q, s = f"g1e{rng.randrange(40)}", f"g2e{rng.randrange(40)}"
        shift = lambda: rng.choice([0, 5, -400, 900]) if inverted else rng.choice([0, 5])
        places = []
        for x in (q, s):
            a = at[x][4] + shift()
            places += [at[x][3], a, a + rng.choice([20, -30] if inverted else [20, 40])]
        rows.append((q, s, rng.random(), *places, i + 2**60 + 1))
    return exons, rows


def nodes_of(spark, exons, rows, observed=False, tile=1024):
    df, info = spark.createDataFrame(rows, HITS), spark.createDataFrame(exons, EXONS)
    best = hits.best_hits(df, "K")
    return df, info, best, tree.scored_nodes(tree.numbered_leaves(df, observed), info, best, tile)


@pytest.mark.parametrize("seed", range(3))
def test_heights_equal_the_naive_method(seed):
    rng = random.Random(seed)
    places = [(a := rng.randrange(500), a + rng.randrange(40), b := rng.randrange(500), b + rng.randrange(40)) for _ in range(12)]
    i, j, h = tree.spanning_tree(np.array(places))
    child1, child2, height = tree.merged(len(places), np.minimum(i, j), np.maximum(i, j), h)
    assert sorted(height[len(places) :]) == sorted(single_linkage(places)) and (np.diff(height[len(places) :]) >= 0).all()
    low, high = tree.positions(child1, child2)
    assert (low[-1], high[-1]) == (0, len(places)) and sorted(low[: len(places)]) == list(range(len(places)))
    for k in range(len(places), len(child1)):
        assert {low[child1[k]], high[child2[k]]} == {low[k], high[k]} and high[child1[k]] == low[child2[k]]


@pytest.mark.parametrize("tile", [3, 16, 64])
def test_tiles_change_no_edge(spark, tile):
    """The tree of far and near, equal and overlapping hits is that of one block, edge by edge."""
    rng = random.Random(tile)
    rows = []
    for pair in range(2):
        for leaf in range(150):
            a, b = rng.choice([0, 1000, 50_000]) + rng.randint(0, 60) * 10, rng.choice([0, 70_000]) + rng.randint(0, 60) * 10
            rows.append((f"x{pair}", "y", leaf, a, a + rng.choice([0, 5, 30, -20]), b, b + 12))
    rows.append(("z", "y", 0, 1, 2, 3, 4))
    leaves = spark.createDataFrame(rows, "g1chr string, g2chr string, leaf long, g1start long, g1end long, g2start long, g2end long")
    found = tree.linkage(leaves, tile).toPandas()
    assert not found.duplicated(["g1chr", "g2chr", "i", "j"]).any()
    for pair in ("x0", "x1"):
        own = [r for r in rows if r[0] == pair]
        edges = found[found.g1chr == pair].sort_values(["height", "i", "j"])
        above = list(range(len(own)))
        kept = []
        for i, j, h in edges[["i", "j", "height"]].itertuples(index=False):
            while above[i] != i:
                i = above[i]
            while above[j] != j:
                j = above[j]
            if i != j:
                above[j] = i
                kept.append(h)
        whole = tree.spanning_tree(np.array([r[3:] for r in own]))
        assert kept == sorted(whole[2]) == sorted(single_linkage([r[3:] for r in own]))
        best = {(min(i, j), max(i, j), h) for i, j, h in zip(*whole, strict=True)}
        assert best <= set(edges[["i", "j", "height"]].itertuples(index=False, name=None))
    assert not len(found[found.g1chr == "z"])


@pytest.mark.parametrize(("kind", "share"), [("uniform", 0.06), ("diagonal", 0.1), ("clusters", 0.2)])
def test_few_tiles_meet(kind, share):
    """Of 40,000 hits in tiles of 256 few pairs of tiles may share an edge, and those that do are among them."""
    rng, n, far = np.random.default_rng(1), 40_000, 10**7
    x, y = rng.uniform(0, far, (2, n))
    if kind == "diagonal":
        y = np.where(rng.random(n) < 0.2, y, x + rng.normal(0, 2000, n))
    if kind == "clusters":
        at = rng.integers(0, 30, n)
        x, y = (rng.uniform(0, far, 30)[at] + rng.normal(0, far / 200, n) for _ in range(2))
    places = np.stack([x, x + 90, y, y + 60], 1).astype(np.int64)
    own = np.zeros(n, np.int64)
    strips = np.array_split(np.argsort(x), 13)
    number = 0
    for strip in strips:
        for part in np.array_split(strip[np.argsort(y[strip])], 12):
            own[part] = number
            number += 1
    tiles = [places[own == k] for k in range(number)]
    step = np.array([linkage.spanning_tree(t)[2].max() for t in tiles])
    lows, highs = np.array([t[:, [0, 2]].min(0) for t in tiles]), np.array([t[:, [1, 3]].max(0) for t in tiles])
    met = linkage.met_tiles(lows, highs, step, np.array([t[[0, 5, 9, 40, -1, -5, -9, -40]] for t in tiles]))
    bound = {(a, b): d for a, b, d in zip(*met, strict=True)}
    assert len(bound) == len(met[0]) < share * number * (number - 1) / 2
    for _ in range(30):  # edges of the trees of any two tiles that are not met are no longer than the way around
        a, b = sorted(rng.choice(number, 2, replace=False))
        gap = np.maximum(0, np.maximum(lows[a], lows[b]) - np.minimum(highs[a], highs[b])).sum()
        assert (a, b) in bound or gap > max(step[a], step[b])


@pytest.mark.parametrize(("n", "leaves"), [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3)])
def test_the_last_hit_is_dropped_when_observed(spark, n, leaves):
    rows = [("q", "s", 1.0, "c", 0, 1, "c", 0, 1, k) for k in range(n)]
    assert tree.numbered_leaves(spark.createDataFrame(rows, HITS)).where("leaf IS NOT NULL").count() == leaves


def test_micro_tree(spark):
    rows = [("q0", "s0", 0.5, "c", 100, 200, "d", 50, 150, 0), ("q1", "s1", 0.5, "c", 250, 300, "d", 160, 260, 1), ("q2", "s2", 0.5, "c", 1000, 1100, "d", 900, 990, 2)]
    exons = [(f"{x}{k}", f"p{x}{k}", f"genome_{1 + (x == 's')}", "cd"[x == "s"], 1, 2, "+") for x in "qs" for k in range(3)]
    got = sorted((r.node_id, r.child1, r.child2, r.height) for r in nodes_of(spark, exons, rows)[3].collect())
    assert got == [(0, -1, -1, 0), (1, -1, -1, 0), (2, -1, -1, 0), (3, 0, 1, 60), (4, 2, 3, 1340)]
    got = sorted((r.node_id, r.child1, r.child2, r.height) for r in nodes_of(spark, exons, rows, observed=True)[3].collect())
    assert got == [(0, -1, -1, 0), (1, -1, -1, 0), (2, 0, 1, 60)]


@pytest.mark.parametrize("inverted", [False, True])
def test_scores_equal_the_naive_model(spark, inverted):
    exons, rows = genome(random.Random(8), inverted=inverted)
    _, _, _, nodes = nodes_of(spark, exons, rows, tile=5)
    found = nodes.collect()
    table = pd.DataFrame([r.asDict() for r in found])
    best = {}
    for q, s, k, *_ in rows:
        for x in (q, s):
            best[x] = max(best.get(x, 0), k)
    gene = {e[0]: e[1] for e in exons}
    for (c1, c2), part in table.groupby(["g1chr", "g2chr"]):
        own = {r[9]: r for r in rows if (r[3], r[6]) == (c1, c2)}
        at = {r.leaf_lo: r.row_idx for r in found if (r.g1chr, r.g2chr) == (c1, c2) and r.child1 < 0}
        assert len(part) == 2 * len(own) - 1
        assert sorted(part[part.child1 >= 0].height) == sorted(single_linkage([(r[4], r[5], r[7], r[8]) for r in own.values()]))
        for node in part.itertuples():
            members = [own[at[x]] for x in range(node.leaf_lo, node.leaf_hi)]
            used = {r[0] for r in members} | {r[1] for r in members}
            free = []
            for g, c, a, b in ((1, c1, 4, 5), (2, c2, 7, 8)):
                lo, hi = min(r[a] for r in members), max(r[b] for r in members)
                assert (lo, hi) == ((node.g1lo, node.g1hi) if g == 1 else (node.g2lo, node.g2hi))
                lo, hi = min(lo, hi), max(lo, hi)
                free.append([e[0] for e in exons if e[2] == f"genome_{g}" and e[3] == c and e[4] < e[5] and lo < hi and e[4] < hi and e[5] > lo and e[0] not in used])
            lost = sum(best.get(e, 0) for f in free for e in f)
            assert (node.n_a, node.n_u1, node.n_u2) == (len(used), len(free[0]), len(free[1]))
            assert (node.n_u1_hit, node.n_u2_hit) == tuple(sum(e in best for e in f) for f in free)
            assert node.score == pytest.approx(2 * sum(r[2] for r in members) - lost)
            assert node.conservation == pytest.approx(len(used) / (1 + sum(e in best for f in free for e in f)))
            assert (node.genes1, node.genes2) == (len({gene[r[0]] for r in members}), len({gene[r[1]] for r in members}))


def test_a_tree_of_many_shapes_equals_the_naive_model():
    """Random trees with repeated exons, unknown exons, hits off their exons, and hits that run backwards."""
    turned = 0
    for seed in range(100):
        rng = random.Random(seed)
        many, n, off, back = rng.choice([3, 10, 40]), rng.choice([1, 2, 3, 10, 40]), rng.choice([0, 300, 1000]), rng.choice([0, 0.3, 0.9, 1])
        exons = [pd.DataFrame([(f"{g}e{k}", a := rng.randrange(40 * many), a + rng.choice([0, 30, 60, 150]), rng.choice([None, rng.random()])) for k in range(many)], columns=["exonid", "start", "end", "best"]).astype({"best": float}) for g in (1, 2)]
        rows = []
        for i in range(n):
            of, places = (rng.randrange(many + 1), rng.randrange(many + 1)), []
            for side, k in zip(exons, of, strict=True):
                a = (side.start[k] if k < many else 5) + rng.choice([0, 5, -off, off])
                b = a + rng.choice([20, 40, 0, 100])
                places += [b, a] if rng.random() < back else [a, b]
            rows.append((f"1e{of[0]}", f"2e{of[1]}", rng.random(), *places, of[0] // 3, of[1] // 3, i))
        table = pd.DataFrame(rows, columns=["qseqid", "sseqid", "K", *linkage.PLACES, "gene1", "gene2", "row_idx"])
        a, b, h = linkage.spanning_tree(table[linkage.PLACES].to_numpy())
        nodes = tree.node_rows(table, (np.minimum(a, b), np.maximum(a, b), h), *exons)
        turned += int(((nodes.g1lo > nodes.g1hi) & (nodes.child1 >= 0)).sum())
        at = {nodes.leaf_lo[k]: rows[k] for k in range(n)}
        for node in nodes.itertuples():
            members = [at[x] for x in range(node.leaf_lo, node.leaf_hi)]
            used = {m[0] for m in members} | {m[1] for m in members}
            free = []
            for side, c in zip(exons, (3, 5), strict=True):
                low, high = sorted((min(m[c] for m in members), max(m[c + 1] for m in members)))
                free.append([e for e in side.itertuples() if e.start < e.end and low < high and e.start < high and e.end > low and e.exonid not in used])
            hit = [sum(e.best == e.best for e in f) for f in free]
            assert (node.n_a, node.n_u1, node.n_u2, node.n_u1_hit, node.n_u2_hit) == (len(used), *map(len, free), *hit)
            assert (node.genes1, node.genes2) == (len({m[7] for m in members}), len({m[8] for m in members}))
            assert node.sum_k == pytest.approx(sum(m[2] for m in members)) and node.conservation == pytest.approx(len(used) / (1 + sum(hit)))
            assert node.score == pytest.approx(2 * sum(m[2] for m in members) - sum(e.best for f in free for e in f if e.best == e.best))
    assert turned > 20


def naive_walk(table, alpha, threshold):
    """The observed search over one table of nodes, with a running count of tests."""
    pairs = {k: p.sort_values("node_id").reset_index(drop=True) for k, p in table.groupby(["g1chr", "g2chr"])}
    tests, seen = 1, set()

    def test(pair, node):
        nonlocal tests
        node %= len(pairs[pair])
        if (pair, node) not in seen:
            seen.add((pair, node))
            tests += bool(pairs[pair].eligible[node])

    now = sorted((k, -1) for k in pairs)
    while True:
        found = set()
        for pair, start in now:
            stack, t = [start], pairs[pair]
            n = len(t)
            while stack:
                node = stack.pop()
                kids = [int(t.child1[node % n]), int(t.child2[node % n])]
                for x in (node, *kids):
                    test(pair, x)
                if t.p[node % n] * tests < alpha:
                    z, a, b = (t.z[x % n] for x in (node, *kids))
                    found |= {(pair, x % n) for x, ok in ((kids[0], a >= z), (kids[1], b > z), (node, z >= a and z > b)) if ok}
                else:
                    stack += [x for x in kids if x != -1]
        if sorted(found) == now:
            return {(*pair, x) for pair, x in found}, tests
        now = sorted(found)


def forest(rng, pairs, most, small):
    """Random trees with random tests; `small` is the size of small p values."""
    parts = []
    for pair in pairs:
        n = rng.randint(1, most)
        h = [rng.randrange(9) for _ in range(n - 1)]
        child1, child2, height = tree.merged(n, np.arange(n - 1), np.arange(1, n), np.array(h, np.int64))
        low, high = tree.positions(child1, child2)
        k = len(child1)
        eligible = [c >= 0 and rng.random() < 0.8 for c in child1]
        z = [rng.choice([float("inf"), 1.0, 3.0, 2.0]) if e else 0.0 for e in eligible]
        p = [0.0 if x == float("inf") else rng.choice([small / 40, small * rng.random(), 0.3]) if e else 1.0 for x, e in zip(z, eligible, strict=True)]
        parts.append(pd.DataFrame({"g1chr": pair[0], "g2chr": pair[1], "node_id": range(k), "child1": child1, "child2": child2, "z": z, "p": p, "eligible": eligible, "leaf_lo": low, "leaf_hi": high}))
    return pd.concat(parts)


@pytest.mark.parametrize("seed", range(6))
def test_walk_equals_the_naive_model(spark, seed):
    table = forest(random.Random(seed), [("a", "x"), ("b", "x"), ("b", "y")], 12, 0.004)
    df = spark.createDataFrame(table)
    want, tests = naive_walk(table, 0.05, 1)
    got = testing.significant(df, 0.05).collect()
    assert {(r.g1chr, r.g2chr, r.node_id) for r in got} == want and all(r.tests == tests for r in got)
    meant = testing.significant(df, 0.05, observed=False).toPandas().merge(table, on=["g1chr", "g2chr", "node_id"])
    assert (meant.p * meant.tests < 0.05).all()
    for _, part in meant.groupby(["g1chr", "g2chr"]):  # no cluster lies within another
        part = part.sort_values("leaf_lo")
        assert (part.leaf_lo.to_numpy()[1:] >= part.leaf_hi.to_numpy()[:-1]).all()


def test_tests_and_clusters(spark):
    exons, rows = genome(random.Random(2), n=40)
    df, info, best, nodes = nodes_of(spark, exons, rows)
    moments = hits.null_moments(df, best, info)
    seen = testing.tested(nodes, moments, 0.2).toPandas()
    held = seen[~seen.eligible]
    assert (held.p == 1).all() and (held.z == 0).all()
    few = seen[seen.eligible & ~seen.clt]
    assert len(few) and (few.p == 0).all() and np.isinf(few.z).all()
    pools = testing.null_pools(df, best, info, "genome_1")
    assert pools.where("pool = 'a'").count() == len(rows)
    meant = testing.tested(nodes, moments, 0.2, observed=False, pools=pools)
    table = meant.toPandas()
    assert table.p.between(0, 1).all()
    again = testing.tested(nodes, moments, 0.2, observed=False, pools=pools).toPandas()
    assert sorted(table.p) == pytest.approx(sorted(again.p))
    tests = testing.tested(nodes, moments, 0.2)
    out = tracks.cluster_table(testing.significant(tests), tests, df, info).collect()
    gene = {e[0]: e[1] for e in exons}
    assert out
    for r in out:
        assert r.genesA == sorted(r.genesA) and set(r.genesA) <= set(gene.values())
        assert r.clusterID == -1 or r.clusterID >= 0


@pytest.mark.parametrize("seed", range(3))
def test_walk_of_each_pair_in_its_own_task(spark, seed):
    """Counts that are chained over pairs give what the naive model counts one by one."""
    table = forest(random.Random(100 + seed), [(a, b) for a in "abcd" for b in "xyz"], 30, 0.03)
    df = spark.createDataFrame(table)
    want, tests = naive_walk(table, 0.05, 1)
    for most in (0, 10**6):
        got = testing.significant(df, 0.05, most=most).collect()
        assert {(r.g1chr, r.g2chr, r.node_id) for r in got} == want and all(r.tests == tests for r in got)


def test_a_round_says_for_which_counts_it_is_the_same():
    rng = random.Random(4)
    for _ in range(40):
        table = forest(rng, [("a", "x")], 12, 0.04)
        start = rng.randint(1, 40)
        walk = testing.Walk(table)
        found, after = walk.round([walk.root], 0.05, start)
        same = []
        for other in range(1, 80):
            w = testing.Walk(table)
            same.append((w.round([w.root], 0.05, other) == (found, other + after - start), walk.low <= other <= walk.high))
        assert same[start - 1] == (True, True) and all(alike for alike, within in same if within)


def test_most_tests():
    for p in (0.05, 1e-9, 0.3, 0.01, 1.0, 5e-324, 0.05 / 3):
        n = testing.most_tests(p, 0.05)
        assert n == testing.NEVER or (p * (n + 1) >= 0.05 and (n < 0 or p * n < 0.05))
    assert testing.most_tests(0.0, 0.05) == testing.NEVER and testing.most_tests(float("nan"), 0.05) == -1


@pytest.mark.parametrize("shape", ["one key", "many"])
def test_running_sums(spark, shape):
    rng = random.Random(3)
    rows = [("k" if shape == "one key" else f"k{rng.randrange(9)}", i, rng.randint(-5, 9)) for i in range(3000)]
    want, sums = {}, {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    assert {r.i: r.upto for r in storage.running(df, ["k"], ["i"], {"upto": F.col("v")}).collect()} == want
    assert storage.running(df.limit(0), ["k"], ["i"], {"upto": F.col("v")}).count() == 0


def pool_rows(spark, a, u1, u2):
    return spark.createDataFrame([(k, float(v)) for k, of in (("a", a), ("u1", u1), ("u2", u2)) for v in of], "pool string, v double")


def test_all_null_scores_are_drawn_from(spark):
    """Populations beyond 50,000, by a broadcast and by a join, against a naive model of the same draws."""
    rng = np.random.default_rng(8)
    a, u1, u2 = rng.random(60_000), rng.random(70_000), rng.random(50)
    a[::1000] += 50
    asked = [(n, 3, 1, s) for n in (2, 12) for s in (0.5, 1.5, 30.0, 90.0)]
    nodes = spark.createDataFrame(asked, "n_a long, n_u1 long, n_u2 long, score double")
    pools = pool_rows(spark, a, u1, u2)
    ordered = {k: np.sort(v) for k, v in (("a", a), ("u1", u1), ("u2", u2))}
    sizes = {k: len(v) for k, v in ordered.items()}
    want = {}
    for n in (2, 12):
        chunks = [testing.drawn_ranks((n, 3, 1), sizes, c, 500, 1) for c in range(4)]
        made = np.concatenate([2 * ordered["a"][x].sum(1) - ordered["u1"][y].sum(1) - ordered["u2"][z].sum(1) for x, y, z in chunks])
        want |= {(n, 3, 1, s): (made >= s).mean() for _, _, _, s in asked}
    for most in (10**6, 0):
        got = {tuple(r)[:4]: r.p for r in testing.permuted(nodes, pools, tests=99, batch=500, stop=10**9, most=most).collect()}
        assert got == pytest.approx(want), most
    assert 0 < want[(12, 3, 1, 30.0)] < 1
    ranks = np.concatenate([testing.drawn_ranks((12, 3, 1), sizes, c, 500, 1)[0] for c in range(20)])
    assert (np.sort(ranks, 1)[:, 1:] != np.sort(ranks, 1)[:, :-1]).all() and abs(ranks.mean() / 30_000 - 1) < 0.02


def test_drawing_stops_early_alike(spark):
    pools = pool_rows(spark, np.arange(40.0), np.arange(30.0), np.arange(20.0))
    nodes = spark.createDataFrame([(2, 1, 0, s) for s in (-100.0, 60.0, 155.0)] + [(1, 0, 0, 5.0), (50, 0, 3, 1500.0)], "n_a long, n_u1 long, n_u2 long, score double")
    ways = [{tuple(r)[:4]: r.p for r in testing.permuted(nodes, pools, tests=60, batch=100, most=m).collect()} for m in (10**6, 0)]
    assert ways[0] == pytest.approx(ways[1]) and len(ways[0]) == 5


def test_ties_and_slices_give_the_same_both_ways(spark):
    """Scores that many draws hit exactly, null scores that repeat, and draws made in slices."""
    pools = pool_rows(spark, [0.1, 0.2, 0.3] * 20, [0.1] * 50, [0.7, 0.1])
    asked = [(5, 3, 1, round(2 * s - 0.3 - u, 10)) for s in (0.9, 1.0, 1.1, 1.2) for u in (0.1, 0.7)] + [(40, 0, 0, 16.0), (40, 0, 0, 16.2)]
    nodes = spark.createDataFrame(asked, "n_a long, n_u1 long, n_u2 long, score double")
    ways = [{tuple(r)[:4]: r.p for r in testing.permuted(nodes, pools, tests=30, batch=100, stop=10**9, most=m, cells=300).collect()} for m in (10**6, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == len(set(asked)) and len({p for p in ways[0].values() if 0 < p < 1}) > 3
    # by plain loops over whole numbers
    whole = {k: np.sort(np.rint(np.array(v) * tree.PARTS).astype(np.int64)) for k, v in (("a", [0.1, 0.2, 0.3] * 20), ("u1", [0.1] * 50), ("u2", [0.7, 0.1]))}
    sizes, need = {k: len(v) for k, v in whole.items()}, int(np.ceil(31 / 0.05))
    made = []
    for chunk in range(-(-need // 100)):
        for _, (x, y, z) in testing.draws_of((5, 3, 1), sizes, chunk, min(100, need - 100 * chunk), 1, 300):
            made += (2 * whole["a"][x].sum(1) - whole["u1"][y].sum(1) - whole["u2"][z].sum(1)).tolist()
    assert len(made) == need
    for key in asked[:8]:
        assert ways[0][key] == sum(m >= round(key[3] * tree.PARTS) for m in made) / need


def test_permutations_draw_what_is_asked(spark):
    """Counts are drawn without replacement, and the share of draws that reach a score is right."""
    pools = pool_rows(spark, [1.0, 2.0, 3.0, 4.0], [0.5] * 30, [0.25])
    asked = [(4, 2, 1, 18.75), (4, 2, 1, 18.8), (1, 0, 0, 8.0), (1, 0, 0, 5.0), (1, 5, 3, -9.0)]
    nodes = spark.createDataFrame(asked, "n_a long, n_u1 long, n_u2 long, score double")
    p = {tuple(r)[:4]: r.p for r in testing.permuted(nodes, pools, tests=200, stop=10**9).collect()}
    assert p[asked[0]] == 1 and p[asked[1]] == 0 and p[asked[4]] == 1
    assert p[asked[2]] == pytest.approx(0.25, abs=0.05) and p[asked[3]] == pytest.approx(0.5, abs=0.05)


@pytest.mark.parametrize("seed", range(40))
def test_documented_walk_equals_repeated_descents(seed):
    """Also of chains deeper than any number of rounds."""
    rng = random.Random(seed)
    table = forest(rng, [("a", "x")], 4000 if seed == 0 else 40, 0.02)
    if seed == 0:  # a chain of which each node scores higher than the one above it
        table["z"] = np.arange(len(table))[::-1].astype(float)
        table["p"] = 1e-9
    walk, now, before = testing.Walk(table), [len(table) - 1], None
    while now != before:
        before, now = now, sorted({x for node in now for x in walk.down(node, 0.05, 7, False, False)[0]})
    assert testing.settled(table.sample(frac=1, random_state=seed), 0.05, 7).tolist() == now


def test_shared_draws_have_the_law_of_each_triple(spark):
    """Against the exact law by counting all draws; sums of one draw for several triples; values beyond those spelt out."""
    values = {"a": [1.0, 2.0, 2.0, 4.0, 7.0], "u1": [0.5, 1.0, 3.0], "u2": [0.25, 0.25, 1.5, 2.0]}
    keys = [(2, 1, 1), (3, 0, 2), (1, 2, 0), (5, 3, 4)]
    asked = []
    for key in keys:
        every = [2 * sum(x) - sum(y) - sum(w) for x in itertools.combinations(values["a"], key[0]) for y in itertools.combinations(values["u1"], key[1]) for w in itertools.combinations(values["u2"], key[2])]
        asked += [(*key, s, np.mean(np.array(every) >= s)) for s in sorted(set(every))[:: max(1, len(set(every)) // 5)]]
    nodes = spark.createDataFrame([r[:4] for r in asked], "n_a long, n_u1 long, n_u2 long, score double")
    found = [{tuple(r)[:4]: r.p for r in testing.permuted_together(nodes, pool_rows(spark, *values.values()), tests=tests, stop=10**9, cells=cells).collect()} for tests, cells in ((999, testing.CELLS), (999, 3000))]
    for p in found:
        for *key, exact in asked:
            assert p[tuple(key)] == pytest.approx(exact, abs=5 * math.sqrt(0.25 / 20_000))
    # one more than there are members: drawn from two copies
    twice = spark.createDataFrame([(6, 0, 0, 31.9), (6, 0, 0, 64.1)], "n_a long, n_u1 long, n_u2 long, score double")
    p = {r.score: r.p for r in testing.permuted_together(twice, pool_rows(spark, *values.values()), tests=99, stop=10**9).collect()}
    assert 0 < p[31.9] < 1 and p[64.1] == 0
    pool = testing.Pool(np.array([3, 5, 9]), np.array([2, 1, 4]))
    spelt = pool.at(np.arange(7)).tolist()
    pool.SPELT = 0
    assert pool.at(np.arange(7)).tolist() == spelt == [3, 3, 5, 9, 9, 9, 9]


def test_scores_are_held_in_pieces(spark, monkeypatch):
    """However many scores there are, the driver sends out no more than it may hold at once; pieces, which cut triples, give the same p."""
    pools = pool_rows(spark, np.arange(40.0), np.arange(30.0), np.arange(20.0))
    asked = [(3, 1, 0, float(s)) for s in range(-30, 240)] + [(2, 1, 0, s / 2) for s in range(-60, 320)] + [(50, 0, 3, 1500.0), (1, 0, 0, 5.0)]
    nodes = spark.createDataFrame(asked, "n_a long, n_u1 long, n_u2 long, score double")
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(sum(len(y[1]) for y in x if isinstance(y[1], np.ndarray)) if isinstance(x, list) else 0) or send(x))
    found = []
    for held in (100, 10**6):
        sent.clear()
        found.append({tuple(r)[:4]: r.p for r in testing.permuted_together(nodes, pools, tests=600, batch=100, held=held).collect()})
        assert max(sent) <= held
    assert found[0] == found[1] and set(found[0]) == set(asked) and len(set(found[0].values())) > 100


@pytest.mark.parametrize("n", [1, 5, 400])
def test_values_that_reach_scores(n):
    rng = np.random.default_rng(n)
    made, scores = rng.integers(-20, 20, 50), np.sort(rng.integers(-25, 25, n))
    assert testing.reached(made, scores).tolist() == [(made >= s).sum() for s in scores]


def test_shared_draws_are_as_many_as_the_longest_triple_takes(spark, monkeypatch):
    """The work doesn't grow with the number of triples."""
    drawn = []
    rows = testing.running_draws
    monkeypatch.setattr(testing, "running_draws", lambda longest, *rest: drawn.append(longest) or rows(longest, *rest))
    pools = {k: testing.Pool(np.arange(50), np.ones(50, np.int64)) for k in testing.POOLS}
    testing.shared_counts([((n, n % 5, n % 3), np.array([0])) for n in range(20)], pools, 10, [1])
    assert sum(drawn) == 19 + 4 + 2


@pytest.mark.parametrize(("inverted", "scale"), [(False, 1), (True, 1), (True, 20_000)])
def test_subtrees_of_tiles_give_the_nodes_of_whole_pairs(spark, inverted, scale):
    """Exons and genes that subtrees share, hits off their exons, ranges that run backwards, and ranges too wide for a tile."""
    exons, rows = genome(random.Random(11), n=160, inverted=inverted)
    exons = [(*e[:4], e[4] * scale, e[5] * scale, e[6]) for e in exons]
    rows = [(*r[:4], r[4] * scale, r[5] * scale, r[6], r[7] * scale, r[8] * scale, r[9]) for r in rows]
    df, info = spark.createDataFrame(rows, HITS), spark.createDataFrame(exons, EXONS)
    leaves, best = tree.numbered_leaves(df), hits.best_hits(df, "K")
    found = [tree.scored_nodes(leaves, info, best, tile=9, few=few).orderBy("g1chr", "g2chr", "node_id").collect() for few in (0, 10**6)]
    assert found[0] == found[1] and len(found[0]) > 200


def test_few_subtrees_are_left_to_a_task_of_a_pair(spark, monkeypatch):
    """Of a pair's 3,000 hits few subtrees meet in its top tree, and no call of Python has the pair's hits or exons."""
    rng, exons, rows = random.Random(2), [], []
    for k in range(3000):
        at = 100 * k + rng.randrange(60)
        exons += [(f"{g}e{k}", f"{g}p{k // 3}", f"genome_{g}", "c", at, at + 30, "+") for g in (1, 2)]
        rows.append((f"1e{k}", f"2e{k}", rng.random(), "c", at, at + 20, "c", at + rng.randrange(9), at + 30, k))
    tables, write = {}, tree.written
    monkeypatch.setattr(tree, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    df, info = spark.createDataFrame(rows, HITS), spark.createDataFrame(exons, EXONS)
    assert tree.scored_nodes(tree.numbered_leaves(df), info, hits.best_hits(df, "K"), tile=128, few=0).count() == 2 * 2999 - 1
    assert tables["tops"].count() < 0.25 * 3000


def test_closed_merges_are_nodes_of_the_whole_tree():
    rng = random.Random(6)
    for reach in (40, 10**9):
        kept = 0
        for _ in range(30):
            places = [(a := rng.randrange(300), a + 3, b := rng.randrange(300), b + 2) for _ in range(40)]
            every = sorted((distance(x, y), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(places), 2))
            parts, nodes = {k: {k} for k in range(40)}, set()
            for _, i, j in every:
                if parts[i] is not parts[j]:
                    both = parts[i] | parts[j]
                    nodes.add(frozenset(both))
                    parts |= dict.fromkeys(both, both)
            mine = [e for e in every if e[1] < 20 and e[2] < 20]
            out = [min(e for e in every if (e[1] == k or e[2] == k) and e[2] >= 20) for k in range(20)]
            merges, _, of = tree.closed([e[1] for e in mine], [e[2] for e in mine], mine, out, places[:20], reach)
            now = {k: {k} for k in range(20)}
            for k in merges:
                both = now[mine[k][1]] | now[mine[k][2]]
                now |= dict.fromkeys(both, both)
                assert frozenset(both) in nodes
                assert all(max(places[x][c + 1] for x in both) - min(places[x][c] for x in both) <= reach for c in (0, 2))
            assert all(min(now[k]) == of[k] for k in range(20))
            kept += len(merges)
        assert kept > 0


@pytest.mark.parametrize("seed", range(4))
def test_nodes_that_the_walk_may_come_to_are_enough(spark, seed):
    table = forest(random.Random(200 + seed), [("a", "x"), ("b", "x"), ("b", "y")], 40, (0.004, 1e-5)[seed % 2])
    df = spark.createDataFrame(table)
    want, tests = naive_walk(table, 0.05, 1)
    kept = testing.reachable(df, 0.05).toPandas()
    assert len(kept) <= len(table) and not kept.duplicated(["g1chr", "g2chr", "node_id"]).any()
    for most in (0, len(table)):
        got = testing.significant(df, 0.05, most=most, whole=0).collect()
        assert {(r.g1chr, r.g2chr, r.node_id) for r in got} == want and all(r.tests == tests for r in got)


def test_the_walk_gets_no_nodes_below_those_that_are_always_significant(spark):
    """A root that always is, and scores higher than its children, leaves itself and these of a large tree."""
    n = 3000
    child1, child2, _ = tree.merged(n, np.arange(n - 1), np.arange(1, n), np.array([x % 7 for x in range(n - 1)], np.int64))
    low, high = tree.positions(child1, child2)
    k = 2 * n - 1
    table = pd.DataFrame({"g1chr": "a", "g2chr": "x", "node_id": range(k), "child1": child1, "child2": child2, "z": [*[1.0] * (k - 1), 9.0], "p": 1e-12, "eligible": True, "leaf_lo": low, "leaf_hi": high})
    df = spark.createDataFrame(table)
    kept = testing.reachable(df, 0.05).toPandas()
    assert sorted(kept.node_id) == sorted([k - 1, int(child1[-1]), int(child2[-1])])
    want, tests = naive_walk(table, 0.05, 1)
    got = testing.significant(df, 0.05, whole=0).collect()
    assert {(r.g1chr, r.g2chr, r.node_id) for r in got} == want and all(r.tests == tests for r in got)
