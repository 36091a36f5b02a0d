"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > j) = logistic(w . x - t_j): one vector of hashed text weights is shared
by all grades, the ordered thresholds t_1 <= t_2 <= ... set them apart. The
expected grade and the tail probability of the better grades select documents.
Documents that a model is fitted on are scored by another one, fitted without
their share of them, so no score comes from a document's own rating.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table, text_slices
from .words import BYTE_VALUES, mix, spans, word_hashes

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Hash values of the bytes that show how a word looks: letters are alike.
MARKS = np.where(LETTER, np.uint64(0), BYTE_VALUES)


@dataclass(frozen=True)
class Ordinal:
    """buckets: of the hash; sample: labelled rows that the model is fitted on, at
    most; least: share of those rows that must have a bucket for it to get a
    weight; good: the grade from which on a document counts as wanted; keep: tail
    probability with which it is kept; folds: shares that the fitted documents are
    dealt to."""

    buckets: int = 1 << 24
    least: float = 0.004
    sample: int = 12_000
    epochs: int = 12
    rate: float = 0.3
    ridge: float = 1e-3
    batch: int = 256
    good: int = 2
    keep: float = 0.5
    seed: int = 5
    folds: int = 3


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of texts: buckets, values and where each row begins.

    Three blocks: the runs of letters that occur, the looks of words (their marks
    without letters) and words that follow themselves, the last two as square
    roots of their shares. Every word of a text counts.
    """
    starts, ends, rows = spans(data, offsets)
    n = len(offsets) - 1
    each = np.diff(rows)
    of = np.repeat(np.arange(n), each)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(n + 1, np.int64)
    words = word_hashes(data, starts, ends)
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    marks = np.concatenate([[np.uint64(0)], np.cumsum(MARKS[data], dtype=np.uint64)])
    only = marks[ends] - marks[starts]
    looks = mix(only + (letters[ends] > letters[starts]).astype(np.uint64) * np.uint64(0x51ED270B))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    twice = np.where(again, np.uint64(0x2545F491), np.uint64(0x9E6C63D0))
    bare = np.where(LETTER[data], data, np.uint8(32))
    first, last, at = spans(bare, offsets)
    runs, of_run = word_hashes(bare, first, last), np.repeat(np.arange(n), np.diff(at))
    parts = []
    for block, (hashes, own, weight) in enumerate(((runs, of_run, 0.5), (looks, of, 1.0), (twice, of, 1.0))):
        key = own * np.int64(buckets) + (mix(hashes + np.uint64(block)) % np.uint64(buckets)).astype(np.int64)
        found, count = np.unique(key, return_counts=True)
        share = np.sqrt(count / each[found // buckets])
        parts.append((found, np.full(len(found), weight) if block == 0 else weight * share))
    key, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    return key % buckets, value, np.searchsorted(key // buckets, np.arange(n + 1))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    """Weights of the buckets that have one, and the ordered thresholds."""

    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade > j) of each row, j = 0, 1, ..."""
        k = np.searchsorted(self.buckets, index)
        k[k == len(self.buckets)] = 0
        own = np.where(self.buckets[k] == index, self.weights[k], 0.0) if len(self.buckets) else np.zeros(len(index))
        sums = np.concatenate([[0.0], np.cumsum(own * value)])
        return logistic((sums[at[1:]] - sums[at[:-1]])[:, None] - self.thresholds[None])


def slopes(score: np.ndarray, base: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades y, its slope by each row's score (not averaged) and by the thresholds' parameters.

    base: the first threshold and the logarithms of the gaps between them.
    """
    t = base[0] + np.concatenate([[0], np.cumsum(np.exp(base[1:]))])
    # P(y) = F(t_y) - F(t_{y-1}) with F the logistic of t - score
    f = np.concatenate([np.zeros((len(y), 1)), logistic(t[None] - score[:, None]), np.ones((len(y), 1))], 1)
    slope, row = f * (1 - f), np.arange(len(y))
    likely = np.maximum(f[row, y + 1] - f[row, y], 1e-12)
    d_score = (slope[row, y + 1] - slope[row, y]) / likely
    d_t = np.zeros((len(y), len(base) + 2))
    d_t[row, y + 1] -= slope[row, y + 1] / likely
    d_t[row, y] += slope[row, y] / likely
    tail = np.cumsum(d_t[:, 1:-1].mean(0)[::-1])[::-1]
    return float(-np.log(likely).mean()), d_score, np.concatenate([[tail[0]], tail[1:] * np.exp(base[1:])])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, p: Ordinal) -> Model:
    """Maximum likelihood by adaptive gradient steps on minibatches; thresholds are kept ordered by positive gaps."""
    met, n = np.unique(np.concatenate([r[0] for r in rows]), return_counts=True)
    buckets = met[n >= max(2, p.least * len(rows))].astype(np.int64)

    def kept(index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(buckets, index)
        ok = k < len(buckets)
        ok[ok] = buckets[k[ok]] == index[ok]
        return k[ok], np.asarray(value)[ok]

    rows = [kept(*r) for r in rows]
    top, rng = int(grades.max(initial=1)), np.random.default_rng(p.seed)
    share = np.array([(grades > j).mean() if len(grades) else 0.5 for j in range(top)]).clip(1e-3, 1 - 1e-3)
    t = np.sort(-np.log(share / (1 - share)))
    base = np.array([t[0], *np.log(np.maximum(np.diff(t), 1e-2))])
    w, gw, gb = np.zeros(len(buckets)), np.full(len(buckets), 1e-8), np.full(top, 1e-8)
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), p.batch):
            chosen = order[i : i + p.batch]
            index, value = (np.concatenate([rows[k][c] for k in chosen]) for c in (0, 1))
            sizes = np.array([len(rows[k][0]) for k in chosen])
            of = np.repeat(np.arange(len(chosen)), sizes)
            score = np.bincount(of, w[index] * value, len(chosen))
            y = grades[chosen]
            _, d_score, d_base = slopes(score, base, y)
            hit, back = np.unique(index, return_inverse=True)
            g = np.bincount(back, d_score[of] * value) / len(y) + p.ridge * w[hit]
            gw[hit] += g * g
            w[hit] -= p.rate * g / np.sqrt(gw[hit])
            gb += d_base * d_base
            base -= 0.1 * d_base / np.sqrt(gb)
    return Model(buckets, w, base[0] + np.concatenate([[0], np.cumsum(np.exp(base[1:]))]))


@dataclass(frozen=True)
class Fitted:
    """model: fitted on all chosen ratings; others: without one share of them each; chosen: (id, fold) of the documents fitted on."""

    model: Model
    others: tuple[Model, ...] = ()
    chosen: DataFrame | None = None


def trained(docs: DataFrame, ratings: DataFrame, p: Ordinal = Ordinal(), id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Fitted | None:
    """Models of graded texts, each fitted in one task on the documents of at most p.sample ratings, chosen by a hash of the id.

    Grades are 0, 1, 2, ...; of several ratings of an id the lowest counts, and
    rows with a null grade or id take no part. A null text counts as empty. None
    if no rated document is left. Rows of one id are in one share.
    """
    usable = ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade")).where("grade >= 0 AND id IS NOT NULL")
    chosen = usable.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id", F.lit(p.seed)), "id").limit(p.sample)
    chosen = staged(chosen.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(p.seed + 1)), F.lit(p.folds)).cast("int")), "chosen")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text"):
                index, value, at = features(data, offsets, p.buckets)
                as_lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (index.astype(np.int32), value.astype(np.float32))]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *as_lists], ["id", "grade", "fold", "index", "value"])

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        model = fit(list(zip(rows["index"], rows["value"], strict=True)), rows["grade"].to_numpy(np.int64), p)
        packed = (base64.b64encode(x.tobytes()).decode() for x in (model.buckets, model.weights, model.thresholds))
        return pd.DataFrame([(key[0], *packed)], columns=["model", "buckets", "weights", "thresholds"])

    rated = texts.join(F.broadcast(chosen), "id").select("id", "text", "grade", "fold")
    rows = staged(rated.mapInArrow(sparse, "id long, grade int, fold int, index array<int>, value array<float>"), "rated")
    # model -1 has all rows, model k those of the other shares
    used = F.array(F.lit(-1), *[F.lit(k) for k in range(p.folds)])
    dealt = rows.withColumn("model", F.explode(used)).where("model != fold")
    found = dealt.groupBy("model").applyInPandas(learn, "model int, buckets string, weights string, thresholds string").collect()
    models = {r.model: Model(*(np.frombuffer(base64.b64decode(x), kind) for x, kind in zip(r[1:], (np.int64, float, float), strict=True))) for r in found}
    if -1 not in models:
        return None
    # all ratings in one share: nothing else to score its documents by
    return Fitted(models[-1], tuple(models.get(k, models[-1]) for k in range(p.folds)), chosen.select("id", "fold"))


def scored(docs: DataFrame, fitted: Fitted, p: Ordinal = Ordinal(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, tail, kept) for each row of docs.

    A null or empty text, or one of white space, has no features and is scored as
    such; ids pass as they are, null or repeated. No other column is read. The
    models' size is fixed by their number of buckets, and the ids that they are
    fitted on are at most p.sample.
    """
    models = docs.sparkSession.sparkContext.broadcast((*fitted.others, fitted.model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_slices(batch, "text"):
                found = features(data, offsets, p.buckets)
                own = fold[i:j]
                tails = models.value[-1].tails(*found)
                for k in np.unique(own[own >= 0]).tolist():
                    tails[own == k] = models.value[k].tails(*found)[own == k]
                tail = tails[:, min(p.good, tails.shape[1]) - 1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(tails.sum(1)), pa.array(tail), pa.array(tail >= p.keep)], ["id", "expected_grade", "tail", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if fitted.chosen is None:
        rows = rows.withColumn("fold", F.lit(-1))
    else:
        rows = rows.join(F.broadcast(fitted.chosen), "id", "left").select("id", "text", F.coalesce("fold", F.lit(-1)).alias("fold"))
    return rows.mapInArrow(work, "id long, expected_grade double, tail double, kept boolean")


def grade(quality: Column, toxic: Column) -> Column:
    """0: toxic, 1: poor, 2: good; null where a rating is missing."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of all documents, by the ratings in labels."""
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = trained(docs, ratings)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("doc_id", nothing.alias("expected_grade"), nothing.alias("tail"), F.lit(True).alias("kept"))
    return scored(docs, model).withColumnRenamed("id", "doc_id")
