import math
import os

import numpy as np
import pytest

from locusweave.llm import neighbours
from locusweave.llm.neighbours import Scan

DIR = "/root/testdata/sf0.01"


def brute(rows, queries, k=10):
    out = {}
    for q in queries:
        far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(rows[q], v, strict=True))), i) for i, v in rows.items() if i != q)
        out[q] = far[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 32))
    made = {i: (centres[i % 12] + 0.4 * rng.normal(size=32)).tolist() for i in range(2400)}
    for i in range(0, 900, 3):  # one vector that many rows share
        made[i] = centres[0].tolist()
    return made


def test_recall_and_exact_scores(spark, vectors):
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    p = Scan(block=200, queries=5)
    found = neighbours.searched(neighbours.indexed(df, p), df.where("vec_id % 100 = 0"), p).collect()
    want, hit = brute(vectors, range(0, 2400, 100)), 0
    for q, near in want.items():
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        for r in got:
            assert r.score == pytest.approx(math.dist(vectors[q], vectors[r.vec_id]), abs=1e-12)
        hit += len({r.vec_id for r in got} & {i for _, i in near})
    assert hit >= 0.9 * 10 * len(want)
    # ties of the shared vector go to the smallest ids
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 300), key=lambda r: r.rank)] == list(range(0, 30, 3))


def test_all_lists_are_exact(spark, vectors):
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    p = Scan(promise=1.0, confidence=50.0)
    found = neighbours.searched(neighbours.indexed(df, p), df.where("vec_id % 400 = 0"), p).collect()
    want = brute(vectors, range(0, 2400, 400))
    assert {(r.query_id, r.rank, r.vec_id) for r in found} == {(q, k + 1, i) for q, near in want.items() for k, (_, i) in enumerate(near)}


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0]), (7, [3.0, 2.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 2.5]), (100, [1.0, 2.5]), (9, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, list string")
    for c in ("id", "vector", "limit", "part", "parts", "crowd", "far", "query_id", "score", "rank"):
        df = df.selectExpr("*", f"list AS `{c}`")
    found = neighbours.searched(neighbours.indexed(df), df.where("vec_id % 100 = 0")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found)] == [(0, 1, 6), (0, 2, 100), (0, 3, 100), (0, 4, 7), (100, 1, 0), (100, 2, 6), (100, 3, 7)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_recall_on_the_table(spark):
    found = neighbours.op4_nearest(spark, DIR).collect()
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    good = [(r.vec_id, np.array(r.embedding, float)) for r in rows if r.embedding and None not in r.embedding and np.isfinite(np.array(r.embedding, float)).all() and any(r.embedding)]
    good = [(i, v) for i, v in good if len(v) == len(good[0][1])]
    ids, all_ = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hit = asked = 0
    for i, v in good:
        if i % 100 == 0:
            far = np.sqrt(((all_ - v) ** 2).sum(1))
            order = [k for k in np.lexsort((ids, far)) if ids[k] != i][:10]
            got = [r.vec_id for r in found if r.query_id == i]
            assert len(got) == 10
            hit += len(set(got) & set(ids[order].tolist()))
            asked += 10
    assert hit >= 0.9 * asked


def test_queries_with_too_few_found_visit_all_lists(spark, vectors):
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    p = Scan(promise=1e-9)
    found = neighbours.searched(neighbours.indexed(df, p), df.where("vec_id % 100 = 0"), p)
    assert {r["count"] for r in found.groupBy("query_id").count().collect()} == {10}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.indexed(empty) is None
