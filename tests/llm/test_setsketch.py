import random

import numpy as np

from locusweave.llm import setsketch
from locusweave.llm.graph import components
from locusweave.llm.setsketch import SetSketch, near_duplicates

from .conftest import ODD, prose


def brute(rows, k, percent):
    """(id, size, component) by all pairs."""
    sets = {}
    for i, text, *_ in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def copies(rng, n=260):
    """Groups of near copies of many degrees, chains among them."""
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.7:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            text = " ".join(words)
        else:
            text = prose(i, rng.choice([1, 2, 3, 8, 40, 150]))
        texts.append(text)
        rows.append((i, text.upper() if rng.random() < 0.1 else text, "en", "s"))
    return rows


def test_equals_brute_force(documents):
    rng = random.Random(5)
    rows = copies(rng)
    for p in (SetSketch(k=3, percent=85), SetSketch(), SetSketch(k=3, percent=85, small=2, block=8)):
        found = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows, extra=True), p).collect()}
        assert found == brute(rows, p.k, p.percent)


def test_odd_rows(documents):
    found = near_duplicates(documents(ODD, extra=True), SetSketch(k=3, percent=85)).collect()
    assert len(found) == len(ODD)
    for r in found:
        assert r.component_id == r.id and r.kept or r.id is None
    assert {r.n_shingles for r in found if r.id in (1, 2, 3)} == {0}
    assert {r.n_shingles for r in found if r.id == 4} == {1}


def test_empty_table(documents):
    assert near_duplicates(documents([])).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    p = SetSketch()
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:]
    sketch = lambda x: setsketch.register_values(x, np.array([0, len(x)]), p)
    assert (setsketch.merged(sketch(a), sketch(b)) == sketch(pool)).all()
    best, ok = setsketch.estimate(sketch(a), sketch(b), np.array([2000.0]), np.array([2500.0]), p)
    assert abs(best[0] - 0.5) < 0.12 and not ok[0]


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            ra, rb = sorted((root(a), root(b)))
            up[rb] = ra
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {x: root(x) for x in up}
