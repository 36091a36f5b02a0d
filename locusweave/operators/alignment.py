"""Protein alignment: like words on one diagonal find pairs of sequences, whose diagonals are filtered without gaps and extended with gaps within bands.

This stands in for an external aligner, whose tables can be read instead
(sources.readers.hits).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.operators import extension, scoring
from locusweave.operators.scoring import CODES, LETTERS, SCORES
from locusweave.storage import written

ALIGNED = "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, sstart long, send long, evalue double, bitscore double, slen long, qlen long"


#: Letters of a word that seeds an alignment.
WORD = 3


@cache
def word_neighbours(threshold: int) -> pd.DataFrame:
    """(word, near): words of WORD letters and those that score at least `threshold` with them."""
    one = SCORES[CODES[:, None], CODES[None]].astype(np.int8)
    n = len(LETTERS)
    total = one
    for _ in range(WORD - 1):  # scores of words of one letter more
        total = (total[:, None, :, None] + one[None, :, None, :]).reshape(total.shape[0] * n, -1)
    spelt = np.array(["".join(x) for x in product(LETTERS, repeat=WORD)])
    a, b = np.nonzero(total >= threshold)
    return pd.DataFrame({"word": spelt[a], "near": spelt[b]})


def word_places(rows: DataFrame) -> DataFrame:
    """(id, at, word): the words of sequences and their first places, from 1."""
    starts = F.when(F.length("seq") >= WORD, F.sequence(F.lit(1), F.length("seq") - (WORD - 1)))
    return rows.select("id", F.upper("seq").alias("seq"), F.explode(starts).alias("at")).select("id", "at", F.substr("seq", F.col("at"), F.lit(WORD)).alias("word"))


def diagonal_seeds(queries: DataFrame, subjects: DataFrame, threshold: int = 11, window: int = 40, crowd: int = 100_000) -> DataFrame:
    """(qseqid, sseqid, diagonals): pairs of sequences (id, seq) with two like words on one diagonal, at most `window` letters apart and not overlapping.

    Words are like if they score at least `threshold`; those of the queries are
    replaced by all that are like them, a table bounded by the alphabet. A word that subjects
    have more than `crowd` times is spread over salts by their places, so no task
    gets all places of a word. diagonal: place in the query less that in the subject.
    """
    spark = queries.sparkSession
    near = spark.createDataFrame(word_neighbours(threshold), "word string, near string")
    found = written(word_places(subjects), "words")
    counts = found.groupBy("word").count().where(F.length(F.regexp_replace("word", f"[{LETTERS}]", "")) == 0)  # no more than the words there are
    salts = written(counts.select("word", F.ceil(F.col("count") / crowd).cast("int").alias("salts")), "salts")
    asked = word_places(queries).join(F.broadcast(near), "word").select(F.col("id").alias("qseqid"), F.col("at").alias("q"), F.col("near").alias("word"))
    asked = asked.join(F.broadcast(salts), "word").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    dealt = found.join(F.broadcast(salts), "word").select(F.col("id").alias("sseqid"), F.col("at").alias("s"), "word", F.pmod(F.xxhash64("id", "at"), F.col("salts")).cast("int").alias("salt"))
    met = asked.join(dealt, ["word", "salt"]).groupBy("qseqid", "sseqid", (F.col("q") - F.col("s")).alias("diagonal")).agg(F.array_sort(F.collect_set("q")).alias("at"))
    # of places in order, those WORD further at most tell whether any two that don't overlap are near
    apart = lambda i, k: F.get("at", i + k) - F.get("at", i)
    near_by = lambda i: reduce(lambda x, y: x | y, [F.coalesce(apart(i, k).between(WORD, window), F.lit(False)) for k in range(1, WORD + 1)])
    two = F.exists(F.sequence(F.lit(0), F.size("at") - 1), near_by)
    return met.where((F.size("at") > 1) & two).groupBy("qseqid", "sseqid").agg(F.collect_list("diagonal").alias("diagonals"))


#: Score without gaps from which a diagonal is aligned with gaps.
TRIGGER = 22


def aligned(queries: DataFrame, subjects: DataFrame, threshold: int = 11, window: int = 40, evalue: float = 10.0, trigger: int = TRIGGER, band: int = extension.BAND) -> DataFrame:
    """Hits of queries against subjects (id, seq) in the columns of an alignment table: alignments up to the expectation value of each pair with two like words near each other on one diagonal (see `diagonal_seeds`).

    Of those diagonals, the ones that score `trigger` without gaps are aligned with
    gaps, `band` diagonals to either side and more where the way comes near the edge.
    What crosses a better alignment of its pair is none. Expectation values: see `scoring`.
    Sequences that are null, or shorter than a word, have no hits. Ids are unique.
    """
    whole = subjects.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("letters"), F.count("seq").alias("sequences"))
    side = lambda df, x: df.select(F.col("id").alias(f"{x}seqid"), F.col("seq").alias(f"{x}seq"))
    pairs = diagonal_seeds(queries, subjects, threshold, window).join(side(queries, "q"), "qseqid").join(side(subjects, "s"), "sseqid").join(F.broadcast(whole))

    def align(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            q, s = ([scoring.residues(x) for x in part[c]] for c in ("qseq", "sseq"))
            near = [np.asarray(x, np.int64) for x in part["diagonals"]]
            of = np.repeat(np.arange(len(part)), [len(x) for x in near])
            flat = np.concatenate([np.zeros(0, np.int64), *near])
            strong = extension.ungapped([q[p] for p in of], [s[p] for p in of], flat) >= trigger
            scale = scoring.scales(*(np.array([scoring.composition(x) for x in side]).reshape(-1, len(scoring.LETTERS)) for side in (q, s)))
            space = scoring.search_space(np.array([len(x) for x in q]), part["letters"].to_numpy(), part["sequences"].to_numpy())
            least = [scoring.least_score(*x, evalue) for x in zip(space, scale, strict=True)]
            starts = [x.tolist() for x in np.split(flat[strong], np.searchsorted(of[strong], np.arange(1, len(part))))]
            rows = []
            for p, found in enumerate(extension.alignments(q, s, starts, least, band)):
                for score, q1, q2, s1, s2, length, same, gapopen, _, _ in np.array(found).tolist():
                    gaps = 2 * length - (q2 - q1 + 1) - (s2 - s1 + 1)
                    expected = scoring.KAPPA * space[p] * math.exp(-scale[p] * score)
                    rows.append((part["qseqid"].iat[p], part["sseqid"].iat[p], 100.0 * same / length, length, length - same - gaps, gapopen, q1, q2, s1, s2, expected, scoring.bits_of(score, scale[p]), len(s[p]), len(q[p])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")])

    return pairs.mapInPandas(align, ALIGNED).where(F.col("evalue") <= evalue)
