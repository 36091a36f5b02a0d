import collections
import math
import random
import re

import numpy as np
import pytest

from locusweave.llm.entropy import Difference, cross_entropy_difference, numbers, planes

from .conftest import ODD


def brute(rows, good, p):
    """(tokens, target loss, background loss) of each row, one word at a time."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, *_ in rows]
    words = len({w for t in texts for w in t})
    target = [r[0] in good and r[0] is not None for r in rows]
    of = lambda t: collections.Counter(tuple(t[i : i + k]) for k in (1, 2, 3) for i in range(len(t) - k + 1))

    def counts(some):
        total = collections.Counter()
        for t in some:
            total.update(of(t))
        return total, sum(map(len, some))

    def loss(t, model, out):
        met, n = model
        mine = of(t) if out else collections.Counter()
        left = lambda *key: met[key] - mine[key]
        all_, sums = n - (len(t) if out else 0), 0.0
        for i, w in enumerate(t):
            x = (left(w) + 0.5) / (all_ + 0.5 * words)
            if i > 0:
                x = (left(t[i - 1], w) + p.bigram_mass * x) / (left(t[i - 1]) + p.bigram_mass)
            if i > 1:
                x = (left(*t[i - 2 : i + 1]) + p.trigram_mass * x) / (left(*t[i - 2 : i]) + p.trigram_mass)
            sums -= math.log(x)
        return sums / len(t)

    all_, of_target = counts(texts), counts([t for t, g in zip(texts, target, strict=True) if g])
    return [(len(t), loss(t, of_target, g), loss(t, all_, True)) if t else (0, None, None) for t, g in zip(texts, target, strict=True)]


def rows_of(rng, n=60):
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(rng.choices(words[: 10 + 30 * (i % 2)], k=rng.randint(0, 60))), "en", "s") for i in range(n)]


@pytest.mark.parametrize("p", [Difference(), Difference(block=200, bucket=40), Difference(ids_broadcast=0, block=2000, bucket=500)])
def test_equals_brute_force(spark, documents, p):
    rows = [*rows_of(random.Random(4)), *ODD]
    good = {i for i in range(0, 60, 3)} | {6}
    ids = spark.createDataFrame([(i,) for i in [*good, None, 3]], "doc_id long")
    found = cross_entropy_difference(documents(rows, extra=True), ids, p).collect()
    want = sorted(((r[0], *w) for r, w in zip(rows, brute(rows, good, p), strict=True)), key=repr)
    got = sorted(((r.id, r.tokens, r.target_loss, r.background_loss) for r in found), key=repr)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2:] == (pytest.approx(b[2], abs=1e-9), pytest.approx(b[3], abs=1e-9)) if b[1] else a == b
    assert all(r.score == pytest.approx(r.target_loss - r.background_loss) for r in found if r.tokens)


def key(row):
    return str(row[0]), row[1], round(row[2] or 0, 6)


def test_target_texts_score_lower(spark, documents):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices([f"{'ab'[i % 2]}{k}" for k in range(30)], k=80)), "en", "s") for i in range(80)]
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    score = {r.id: r.score for r in cross_entropy_difference(documents(rows), ids).collect()}
    assert max(score[i] for i in range(60, 80, 2)) < min(score[i] for i in range(61, 80, 2))


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "doc_id long")
    assert cross_entropy_difference(documents([]), none).count() == 0
    found = cross_entropy_difference(documents(ODD), none).collect()
    assert len(found) == len(ODD) and all(r.score is not None for r in found if r.tokens)


def test_copies_are_told_from_single_texts(spark, documents):
    rng = random.Random(9)
    common = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(common, weights=[1 / (k + 1) for k in range(200)], k=60)), "en", "s") for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "t") for i in range(0, 40)]
    none = spark.createDataFrame([], "doc_id long")
    loss = {r.id: r.background_loss for r in cross_entropy_difference(documents(rows), none).collect()}
    assert max(loss[i] for i in [*range(40), *range(1000, 1040)]) < min(loss[i] for i in range(40, 300))


def test_numbers_survive_planes():
    for x in (np.zeros(0, np.uint64), np.array([0, 0]), np.array([1, 255, 256, 2**52 - 1, 0])):
        assert numbers(planes(x), len(x)).tolist() == x.tolist()
