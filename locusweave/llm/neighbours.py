"""Approximate nearest neighbours: an inverted-list index scanned by an adaptive dimension test.

Vectors are rotated at random, so that the squared distance over the first d of
D rotated components, times D / d, estimates the whole. Each probed list is
scanned in blocks of columns; after each block, candidates whose estimate
exceeds the k-th distance so far by more than chance allows are abandoned. The
survivors' distances are computed exactly on the original vectors.

A query's k-th distance begins as that among the sample, whose size is fixed. How
many rows below it each list may hold follows from the list's distances to its
centre; a query visits the lists that promise most, until they hold the asked
share of all. So clustered vectors need few lists, and evenly spread ones many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table


@dataclass(frozen=True)
class Scan:
    """k: neighbours a query; sample: rows that the centroids and first k-th
    distances come from, at most (every row is indexed); promise: share of the
    promised rows that the visited lists must hold; columns: of a block;
    confidence: standard deviations by which an estimate must exceed the k-th
    distance; block and queries: candidates and queries that meet in one task, at
    most on average; dense: share of pairs below which they are followed singly."""

    k: int = 10
    sample: int = 20_000
    promise: float = 0.94
    columns: int = 16
    confidence: float = 2.0
    block: int = 8192
    queries: int = 4096
    dense: float = 0.1
    rounds: int = 8
    seed: int = 11


def rotation(dims: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def centroids(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; an emptied list takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        far = squared(distinct, centres)
        own = far.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, distinct)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for k, row in zip(np.flatnonzero(n == 0), far.min(1).argsort()[::-1], strict=False):
            centres[k] = distinct[row]
    return centres


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of doubles) without vectors that are null, zero or hold null or non-finite components."""
    got = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return got.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def survivors(rotated: np.ndarray, turned: np.ndarray, limit: np.ndarray, p: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, query) that no test abandons; limit: squared k-th distance of each query."""
    dims = rotated.shape[1]
    i = j = partial = None
    alive, sums = np.ones((len(rotated), len(turned)), bool), np.zeros((len(rotated), len(turned)))
    for c in range(0, dims, p.columns):
        x, y = rotated[:, c : c + p.columns], turned[:, c : c + p.columns]
        seen = min(c + p.columns, dims)
        chance = 1.0 if seen == dims else (1 + p.confidence / math.sqrt(seen)) ** 2
        most = limit * chance * (1 + 1e-9) * seen / dims
        if i is None:
            sums += squared(x, y)
            alive &= sums <= most[None] + 1e-12 * (1 + sums)
            if alive.mean() < p.dense or seen == dims:
                i, j = np.nonzero(alive)
                partial = sums[i, j]
        else:
            piece = x[i] - y[j]
            partial = partial + (piece * piece).sum(1)
            keep = partial <= most[j] + 1e-12 * (1 + partial)
            i, j, partial = i[keep], j[keep], partial[keep]
    return i, j


def scan(ids: np.ndarray, original: np.ndarray, rotated: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, turned: np.ndarray, limits: np.ndarray, p: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, distance) of the k nearest rows of each query, ties to smaller ids, but for what the test abandons wrongly.

    limits: first k-th distances; they fall as survivors are measured, part by part.
    """
    limit = np.square(limits)
    who, found, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(ids), 1024):
        for q in range(0, len(queries), 512):
            i, j = survivors(rotated[at : at + 1024], turned[q : q + 512], limit[q : q + 512], p)
            i, j = i + at, j + q
            other = ids[i] != query_ids[j]
            i, j = i[other], j[other]
            difference = original[i] - queries[j]
            who, found, far = (np.concatenate(x) for x in ((who, j), (found, ids[i]), (far, np.sqrt((difference * difference).sum(1)))))
        order = np.lexsort((found, far, who))
        who, found, far = who[order], found[order], far[order]
        first = np.searchsorted(who, who, "left")
        place = np.arange(len(who)) - first
        full = place == p.k - 1
        limit[who[full]] = np.minimum(limit[who[full]], np.square(far[full]))
        kept = place < p.k
        who, found, far = who[kept], found[kept], far[kept]
    return who, found, far


@dataclass(frozen=True)
class Index:
    """rows: (id, vector, list, part); parts: (list, parts), the parts of each list;
    sizes, mean, spread: of each list its rows, and the mean and variance of their
    squared distances to the centre; sample: ids and vectors that the lists come from."""

    rows: DataFrame
    parts: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    sample: tuple[np.ndarray, np.ndarray]

    def promises(self, far: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Rows that each list may hold within each query's limit; far: squared distances of the queries to the centres.

        Squared distances to a list's rows are taken as normal: the way from query to
        centre and that from centre to row meet at random angles.
        """
        middle = far + self.mean[None]
        width = np.sqrt(self.spread[None] + 4 * far * self.mean[None] / self.centres.shape[1] + 1e-300)
        z = (np.square(limit)[:, None] - middle) / width
        return self.sizes[None] * normal_cdf(z)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """Phi, by the logistic series whose error is below 2e-5 of one; tails fall as fast as Phi's."""
    z = np.clip(z, -37.0, 37.0)
    body = 1 / (1 + np.exp(np.clip(-1.5976 * z - 0.07056 * z**3, -700, 700)))
    tail = np.exp(-z * z / 2) / (np.abs(z) * math.sqrt(2 * math.pi) + 1e-9)
    return np.where(z < -4, tail, np.where(z > 4, 1.0, body))


def indexed(vectors: DataFrame, p: Scan = Scan(), id_col: str = "vec_id", vector_col: str = "embedding") -> Index | None:
    """An index of every usable row; None if there is none.

    Vectors must have one length, that of most rows; others take no part. Lists
    number about the square root of the rows, up to a tenth of the sample.
    """
    rows = staged(usable(vectors, id_col, vector_col), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    dims, n = lengths
    rows = rows.where(F.size("vector") == dims)
    share = min(1.0, 1.2 * p.sample / n)
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    taken = chosen.orderBy(F.xxhash64("id", F.lit(p.seed)), "vector").limit(p.sample).select("id", "vector").collect()
    taken = taken or rows.limit(p.sample).select("id", "vector").collect()
    sample_ids, sample = np.array([r[0] for r in taken], np.int64), np.array([r[1] for r in taken]).reshape(-1, dims)
    lists = max(1, min(round(math.sqrt(n)), len(sample) // 10 + 1))
    centres = centroids(sample, lists, p.rounds, p.seed)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = np.stack(part["vector"].to_numpy()) if len(part) else np.zeros((0, dims))
            far = [squared(found[i : i + 1024], centres) for i in range(0, len(found), 1024)]
            part["list"] = np.concatenate([x.argmin(1) for x in far] or [np.zeros(0, np.int64)])
            part["far"] = np.concatenate([x.min(1) for x in far] or [np.zeros(0)])
            yield part[["id", "vector", "list", "far"]]

    listed = staged(rows.mapInPandas(assign, "id long, vector array<double>, list long, far double"), "lists")
    parts = staged(listed.groupBy("list").agg(F.ceil(F.count("*") / p.block).alias("parts"), F.count("*").alias("n"), F.avg("far").alias("mean"), F.var_pop("far").alias("spread")), "parts")
    sizes, mean, spread = np.zeros((3, len(centres)))
    for r in parts.collect():  # a row a list
        sizes[r["list"]], mean[r["list"]], spread[r["list"]] = r["n"], r["mean"], r["spread"]
    dealt = listed.drop("far").join(F.broadcast(parts.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    return Index(dealt, parts.select("list", "parts"), centres, sizes, mean, spread, (sample_ids, sample))


FOUND = "query_id long, vec_id long, score double"


def searched(index: Index, queries: DataFrame, p: Scan = Scan(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, its own id left out, ties to the smaller id.

    Unusable queries, those of another length and repeated rows of one query id
    beyond the first (by vector) take no part. Of candidates, each row stands for
    itself; repeated rows of one id are found as often as they are there.
    """
    centres, dims = index.centres, index.centres.shape[1]
    turn = rotation(dims, p.seed)
    shared = index.rows.sparkSession.sparkContext.broadcast(replace(index, rows=None, parts=None))

    def first_limit(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """k-th distance among the sample, without the query's own row; infinite where that is too small."""
        known, sample = shared.value.sample
        if len(known) <= p.k:
            return np.full(len(ids), math.inf)
        out = []
        for i in range(0, len(ids), 64):
            far = squared(vectors[i : i + 64], sample)
            far[known[None] == ids[i : i + 64, None]] = math.inf
            out.append(np.partition(far, p.k - 1, 1)[:, p.k - 1])
        return np.sqrt(np.concatenate(out)) * (1 + 1e-6) + 1e-9

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for part in parts:
            if not len(part):
                continue
            vectors = np.stack(part["vector"].to_numpy())
            part["limit"] = limit = first_limit(part["id"].to_numpy(), vectors)
            far = squared(vectors, index.centres)
            promised = index.promises(far, np.minimum(limit, 1e150))
            order = np.argsort(-promised, 1, kind="stable")
            held = np.cumsum(np.take_along_axis(promised, order, 1), 1)
            enough = (held < p.promise * held[:, -1:]).sum(1) + 1
            enough[~np.isfinite(limit) | (p.promise >= 1)] = len(index.centres)
            part["list"] = [row[:n].astype(np.int64) for row, n in zip(order, enough, strict=True)]
            yield part[["id", "vector", "limit", "list"]]

    def everywhere(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["limit"] = math.inf
            part["list"] = [np.arange(len(centres))] * len(part)
            yield part[["id", "vector", "limit", "list"]]

    probes = "id long, vector array<double>, limit double, list array<long>"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
    asked = staged(usable(queries, id_col, vector_col).where(F.size("vector") == dims).groupBy("id").agg(F.min("vector").alias("vector")), "asked")
    found = staged(best(_met(index, staged(asked.mapInPandas(probe, probes), "probes"), turn, p)), "found")
    # a query whose lists held fewer rows than it asks for visits all
    short = asked.join(found.where(F.col("rank") == p.k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if short.isEmpty():
        return found
    short = staged(short, "short")
    more = best(_met(index, staged(short.mapInPandas(everywhere, probes), "probes"), turn, p))
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)


def _met(index: Index, probes: DataFrame, turn: np.ndarray, p: Scan) -> DataFrame:
    """(query_id, vec_id, score): what each query (id, vector, limit, list: those that it visits) finds in each part of its lists."""
    probes = probes.select("id", "vector", "limit", F.explode("list").alias("list"))
    crowds = probes.groupBy("list").agg(F.ceil(F.count("*") / p.queries).alias("crowds"))
    # a list's parts meet each of its crowds of queries in a task of their own
    of_list = staged(index.parts.join(crowds, "list"), "crowds")
    probes = probes.join(F.broadcast(of_list), "list").withColumn("crowd", F.pmod(F.xxhash64("id"), F.col("crowds"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = index.rows.join(F.broadcast(of_list), "list").withColumn("crowd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("crowds") - 1)))

    def meet(_: tuple, candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        who = np.zeros(0, np.int64)
        query_ids, found, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(candidates) and len(asking):
            candidates = candidates.sort_values("id", kind="stable")
            original, queries = (np.stack(x["vector"].to_numpy()) for x in (candidates, asking))
            query_ids = asking["id"].to_numpy()
            who, found, far = scan(candidates["id"].to_numpy(), original, original @ turn, query_ids, queries, queries @ turn, asking["limit"].to_numpy(), p)
        return pd.DataFrame({"query_id": query_ids[who], "vec_id": found, "score": far}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["list", "part", "crowd"]
    return rows.groupBy(*keys).cogroup(probes.select("id", "vector", "limit", *keys).groupBy(*keys)).applyInPandas(meet, FOUND)


def op4_nearest(spark, sf_dir: str) -> DataFrame:
    """Contract query: the vectors whose id is divisible by 100 against all."""
    vectors = table(spark, sf_dir, "embeddings")
    index = indexed(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return searched(index, vectors.where("vec_id % 100 = 0"))
