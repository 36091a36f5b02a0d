import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.llm import quality
from locusweave.llm.quality import Fitted, Ordinal

from .conftest import ODD

WORDS = [f"w{i}" for i in range(300)]


def rated(rng, n):
    """Texts whose grade shows: insults for 0, marks for 1."""
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(20, 80))
        grade = rng.choice([0, 1, 2, 2, 2])
        if grade == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vile,", "Nasty", "awful!!"])
        if grade == 1:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = rated(rng, 900)
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.trained(df.select("doc_id", "text"), df.where("doc_id < 600").select("doc_id", "grade"))
    assert all((np.diff(m.thresholds) > 0).all() for m in (model.model, *model.others)) and len(model.others) == 3
    found = {r.id: r for r in quality.scored(df, model).collect()}
    right = [found[i].kept == (g == 2) for i, _, g in rows if i >= 600]
    assert np.mean(right) > 0.95
    means = [np.mean([found[i].expected_grade for i, _, g in rows if i >= 600 and g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    for r in found.values():
        assert 0 <= r.tail <= r.expected_grade <= 2


def test_ratings_do_not_score_their_own_documents(spark):
    """Grades by chance over texts that share nothing: what is fitted on them can't be told in their scores."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"d{i}x{k} {rng.choice(WORDS)}" for k in range(25)), rng.choice([0, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    p = Ordinal(least=0.0)
    model = quality.trained(df.select("doc_id", "text"), df, p)
    chosen = dict(model.chosen.collect())
    assert set(chosen) == set(range(300)) and set(chosen.values()) == {0, 1, 2}
    grade = {i: g for i, _, g in rows}

    def apart(found):
        return np.mean([r.expected_grade for r in found if grade[r.id] == 2]) - np.mean([r.expected_grade for r in found if grade[r.id] == 0])

    out = quality.scored(df, model, p).collect()
    inside = quality.scored(df, Fitted(model.model), p).collect()
    assert abs(apart(out)) < 0.2 < apart(inside)


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(6)
    score, base, y = rng.normal(size=40), np.array([-0.3, 0.2, -0.5]), rng.integers(0, 4, 40)
    loss, by_score, by_base = quality.slopes(score, base, y)
    t = [base[0], base[0] + math.exp(base[1]), base[0] + math.exp(base[1]) + math.exp(base[2])]
    under = lambda g, x: 0.0 if g < 0 else 1.0 if g >= len(t) else 1 / (1 + math.exp(x - t[g]))
    assert loss == pytest.approx(-np.mean([math.log(under(g, x) - under(g - 1, x)) for x, g in zip(score, y, strict=True)]))
    step = 1e-6
    for k in range(3):
        more, less = base.copy(), base.copy()
        more[k] += step
        less[k] -= step
        assert by_base[k] == pytest.approx((quality.slopes(score, more, y)[0] - quality.slopes(score, less, y)[0]) / 2 / step, rel=1e-5, abs=1e-8)
    for k in range(0, 40, 7):
        more, less = score.copy(), score.copy()
        more[k] += step
        less[k] -= step
        assert by_score[k] / 40 == pytest.approx((quality.slopes(more, base, y)[0] - quality.slopes(less, base, y)[0]) / 2 / step, rel=1e-5, abs=1e-8)


def brute_features(text):
    """Values of a text's features by what they stand for."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    is_letter = lambda b: 97 <= b < 123 or b >= 128
    runs = {bytes(r) for w in words for r in re.findall(rb"[a-z\x80-\xff]+", w.encode())}
    looks = collections.Counter((tuple(sorted(b for b in w.encode() if not is_letter(b))), any(map(is_letter, w.encode()))) for w in words)
    twice = collections.Counter(i > 0 and words[i] == words[i - 1] for i in range(len(words)))
    return sorted([0.5] * len(runs) + [math.sqrt(n / len(words)) for c in (looks, twice) for n in c.values()])


def test_features_and_scores_equal_brute_force(spark):
    texts = ["Well well, WELL!! said (the) crow...", "", "a a a b", "Ünï 12 12 x9x #tag", "one"] + [t for _, t, _ in rated(random.Random(3), 8)]
    raw = [t.encode() for t in texts]
    index, value, at = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1 << 40)
    for k, text in enumerate(texts):
        assert sorted(value[at[k] : at[k + 1]].tolist()) == pytest.approx(brute_features(text))
    weights = {int(b): (int(b) % 13 - 6) / 5 for b in np.unique(index)[::2]}
    model = quality.Model(np.array(sorted(weights)), np.array([weights[b] for b in sorted(weights)]), np.array([-0.5, 0.7]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r for r in quality.scored(df, Fitted(model), Ordinal(buckets=1 << 40)).collect()}
    for k in range(len(texts)):
        score = sum(weights.get(int(b), 0.0) * v for b, v in zip(index[at[k] : at[k + 1]], value[at[k] : at[k + 1]], strict=True))
        tails = [1 / (1 + math.exp(t - score)) for t in (-0.5, 0.7)]
        assert (found[k].expected_grade, found[k].tail) == (pytest.approx(sum(tails)), pytest.approx(tails[1]))


def test_expected_grade_is_the_sum_of_tails():
    model = quality.Model(np.array([3]), np.array([2.0]), np.array([-1.0, 1.0]))
    tails = model.tails(np.array([3, 5]), np.array([0.5, 9.0]), np.array([0, 2, 2]))
    want = 1 / (1 + np.exp(-(np.array([[1.0], [0.0]]) - np.array([[-1.0, 1.0]]))))
    assert np.allclose(tails, want)


def test_sample_bounds_the_fit(spark):
    df = spark.createDataFrame(rated(random.Random(2), 120), "doc_id long, text string, grade int")
    p = Ordinal(sample=30, least=0.5)
    assert quality.trained(df.select("doc_id", "text"), df, p) is not None


def test_odd_rows(documents):
    df = documents(ODD, extra=True)
    ratings = df.select("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id") % 3).alias("grade"))
    model = quality.trained(df, ratings)
    assert quality.scored(df, model).count() == len(ODD)


def test_empty_tables(documents):
    empty = documents([])
    ratings = empty.select("doc_id", F.lit(1).alias("grade"))
    assert quality.trained(documents(ODD), ratings) is None
    model = Fitted(quality.Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(2)))
    assert quality.scored(empty, model).count() == 0
    assert quality.scored(documents(ODD), model).count() == len(ODD)
