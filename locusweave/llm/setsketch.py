"""Near-duplicate documents by SetSketch registers.

Each document's set of k-word shingles is sketched by `registers` register
values K = floor(1 - log_base(x)), where x is the least of the exponentially
distributed hashes (rate `rate`) of its shingles: exponentially spaced,
truncated minima. A sketch of a union is the register-wise maximum (`merged`),
and the share of equal registers follows the Jaccard similarity, so runs of
registers ("bands") find candidates. The similarity of candidates is estimated
jointly by likelihood from the registers and both set sizes; those that the
registers can't rule out are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, slices, staged, table, text_slices
from .graph import components
from .words import mix, shingle_hashes, spans, word_hashes


@dataclass(frozen=True)
class SetSketch:
    """Parameters. Documents link if 100 * intersection >= percent * union.

    banded: how many of the registers form bands; all serve the estimate.
    miss: most chance that a pair exactly at the threshold shares no band.
    slack: log-likelihood by which a pair's best similarity may exceed that of
    the threshold before the registers rule it out (10: 4 in a million).
    small: bands of up to so many members are paired by a join, larger ones in
    blocks of at most `block` members and about `block_shingles` shingles.
    """

    k: int = 5
    percent: int = 80
    registers: int = 200
    banded: int = 100
    base: float = 1.001
    rate: float = 20.0
    miss: float = 1e-5
    slack: float = 10.0
    small: int = 8
    block: int = 2048
    block_shingles: int = 1 << 20

    @property
    def rows(self) -> int:
        """Registers a band: as many as keep the chance of a miss under `miss`."""
        fits = [r for r in range(1, self.banded + 1) if (1 - (self.percent / 100) ** r) ** (self.banded // r) <= self.miss]
        return max(fits, default=1)

    @property
    def bands(self) -> int:
        return self.banded // self.rows


def multipliers(registers: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def register_values(shingles: np.ndarray, at: np.ndarray, p: SetSketch) -> np.ndarray:
    """Registers (uint16) of the sets that begin at `at` (the end included); none may be empty."""
    least = np.empty((len(at) - 1, p.registers), np.uint64)
    for i, m in enumerate(multipliers(p.registers)):
        v = shingles * m
        v ^= v >> np.uint64(29)
        least[:, i] = np.minimum.reduceat(v, at[:-1])
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / p.rate
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(p.base)), 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, above: np.ndarray, below: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Of similarity j, given how many registers of a are above, below and equal to b's."""
    u, v, w = na / (na + nb), nb / (na + nb), (base - 1) / base
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * w) / math.log(base)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return above * np.log(np.maximum(up, tiny)) + below * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, p: SetSketch) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of each pair, and whether the threshold or more can't be ruled out."""
    above, below = (ra > rb).sum(1), (ra < rb).sum(1)
    same, top = p.registers - above - below, np.minimum(na, nb) / np.maximum(na, nb)
    grid = np.linspace(0, 1, 51)
    each = np.stack([log_likelihood(g * top, above, below, same, na, nb, p.base) for g in grid], 1)
    best = grid[each.argmax(1)] * top
    t = p.percent / 100
    at = log_likelihood(np.full(len(na), t), above, below, same, na, nb, p.base)
    return best, (top >= t) & ((best >= t) | (each.max(1) - at <= p.slack))


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and where each row's begin."""
    starts, ends, rows = spans(data, offsets)
    all_, at = shingle_hashes(word_hashes(data, starts, ends), rows, k)
    if not len(all_):
        return all_, at
    for a, b in zip(at[:-1], at[1:], strict=True):
        all_[a:b].sort()
    keep = np.ones(len(all_), bool)
    keep[1:] = all_[1:] != all_[:-1]
    keep[at[:-1][at[:-1] < len(all_)]] = True
    return all_[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def fingerprints(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal for equal sets."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(c)), dtype=np.uint64)]) for c in (0x1234567, 0x89ABCDE)]
    return tuple((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)


SKETCH_SCHEMA = "id long, key long, n long, hi long, lo long, registers binary"


def sketches(docs: DataFrame, p: SetSketch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: set size, set fingerprint and registers (null for an empty set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text"):
                sets, at = sets_of(data, offsets, p.k)
                n = np.diff(at)
                hi, lo = fingerprints(sets, at)
                full = np.flatnonzero(n > 0)
                packed = [None] * (j - i)
                if len(full):
                    values = register_values(sets, np.append(at[full], at[-1]), p)
                    for row, x in zip(full, values, strict=True):
                        packed[row] = x.tobytes()
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(hi), pa.array(lo), pa.array(packed, pa.binary())], ["id", "key", "n", "hi", "lo", "registers"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(work, SKETCH_SCHEMA)


def band_keys(registers: np.ndarray, p: SetSketch) -> np.ndarray:
    """A hash of each band's registers and number."""
    total = np.zeros((len(registers), p.bands), np.uint64) + np.arange(p.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(p.rows):
        total = mix(total + registers[:, i : p.bands * p.rows : p.rows].astype(np.uint64))
    return total.view(np.int64)


def _binary(column: pa.Array, p: SetSketch) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, p.registers)


def banded(reps: DataFrame, p: SetSketch) -> DataFrame:
    """(band, id, n): a row for each band of each set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_binary(batch.column(2), p), p)
                ids, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), p.bands) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids), pa.array(n)], ["band", "id", "n"])

    return reps.select("id", "n", "registers").mapInArrow(work, "band long, id long, n long")


def likely(pairs: DataFrame, reps: DataFrame, p: SetSketch) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that the registers can't rule out."""
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(np.full(batch.num_rows, 1), 4096):
                part = batch.slice(i, j - i)
                na, nb = (part.column(c).to_numpy().astype(np.float64) for c in (2, 4))
                best, ok = estimate(_binary(part.column(3), p), _binary(part.column(5), p), na, nb, p)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(best[ok])], ["a", "b", "similarity"])

    # one centre can have a third of all pairs
    joined = looked_up(staged(pairs, "pairs"), side("b"), "b", "a", 0).join(side("a"), "a").where(100 * F.least("na", "nb") >= p.percent * F.greatest("na", "nb"))
    return joined.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(work, "a long, b long, similarity double")


class Sets:
    """Shingle sets by id, of the texts met last; bounded by their total size."""

    def __init__(self, k: int, most: int = 1 << 22) -> None:
        self.k, self.most, self.total, self.known = k, most, 0, OrderedDict()

    def get(self, key: int, text: str) -> np.ndarray:
        if key not in self.known:
            raw = text.encode()
            self.known[key] = found = sets_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), self.k)[0]
            self.total += len(found)
            while self.total > self.most and len(self.known) > 1:
                self.total -= len(self.known.popitem(last=False)[1])
        return self.known[key] if key in self.known else found


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, p: SetSketch) -> DataFrame:
    """The pairs (a, b) that link by their full shingle sets; texts: (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(p.k)
        for batch in batches:
            ok = [linked(sets.get(a, ta), sets.get(b, tb), p.percent) for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    joined = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, p: SetSketch = SetSketch(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_shingles, component_id, kept) for every row of docs; key is a hash of its text.

    Documents of equal sets form a class at once, by its fingerprint. Classes
    that share a band are candidates. Each class is first confirmed against its
    likeliest band centre (the band's smallest id), and then against all band
    mates outside its component, so that only links within a component are left
    out. Large bands are compared in blocks, each inside one task, which returns
    no more than the links that join components.

    A null or empty text, or one of white space only, has an empty set: it is its
    own component and kept. A null id takes no part: component_id is null, kept
    true. Rows of the same id and text are in one class; each is returned. Rows
    of one id but different texts are linked by their sets alone. Other columns
    are not read. An empty table gives no rows.
    """
    all_ = staged(sketches(docs, p, id_col, text_col), "sketches")
    usable = all_.where("n > 0 AND id IS NOT NULL")
    classes = usable.groupBy("n", "hi", "lo").agg(F.min(F.struct("id", "registers")).alias("x"))
    reps = staged(classes.select("n", "hi", "lo", "x.id", "x.registers"), "classes")

    bands = staged(banded(reps, p), "bands")
    # written, so that both sides of the join are shuffled and Spark can split a crowded band
    centres = staged(bands.groupBy("band").agg(F.min("id").alias("c"), F.count("*").alias("m")).where("m > 1").drop("m"), "centres")
    mates = staged(bands.join(centres, "band"), "mates")  # of bands with two members or more
    star = likely(mates.where("id != c").select(F.col("id").alias("a"), F.col("c").alias("b")).distinct(), reps, p)
    star = staged(star, "stars")

    # a third look can pair any band mates, so every mate's text is at hand once
    wanted = mates.select("id").distinct().join(reps.select("id", "n", "hi", "lo"), "id")
    texts = staged(_texts(docs, wanted, p, id_col, text_col), "texts")

    first = star.groupBy("a").agg(F.max(F.struct("similarity", (-F.col("b")).alias("minus"))).alias("x")).select("a", (-F.col("x.minus")).alias("b"))
    parts = staged(components(confirmed(first, texts, p)), "parts")
    mixed = staged(mixed_bands(mates.join(parts, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("component"))), "mixed")
    few = staged(likely(few_mates(mixed.where(F.col("m") <= p.small), p), reps, p), "few")
    links = confirmed(few, texts, p).union(block_links(mixed.where(F.col("m") > p.small), texts, p))
    parts = staged(extended(parts, links), "parts")

    of_set = reps.select("n", "hi", "lo", F.col("id").alias("rep")).join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left")
    found = all_.select("id", "key", "n", "hi", "lo").join(of_set.select("n", "hi", "lo", F.coalesce("component", "rep").alias("found")), ["n", "hi", "lo"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
    return found.select("id", "key", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def _texts(docs: DataFrame, wanted: DataFrame, p: SetSketch, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the wanted classes: one text whose set is the class's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text"):
                part = batch.slice(i, j - i)
                hi, lo = fingerprints(*sets_of(data, offsets, p.k))
                keep = pa.array((hi == part.column(2).to_numpy()) & (lo == part.column(3).to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["id", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    return rows.join(wanted.select("id", "hi", "lo"), "id").select("id", "text", "hi", "lo").mapInArrow(work, "id long, text string").dropDuplicates(["id"])


def extended(parts: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) after linking more pairs; the components are joined as single vertices."""
    parts, more = staged(parts, "before"), staged(more, "links")
    if more.isEmpty():
        return parts
    side = lambda x: parts.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    joined = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    over = components(joined, "ca", "cb").select(F.col("id").alias("component"), F.col("component").alias("over"))
    own = parts.union(joined.select("a", "ca")).union(joined.select("b", "cb")).distinct()
    return own.join(over, "component", "left").select("id", F.coalesce("over", "component").alias("component"))


def mixed_bands(labelled: DataFrame) -> DataFrame:
    """The rows (band, id, n, component) of bands with several components, with the band's members m and shingles."""
    several = labelled.groupBy("band").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("component").alias("x"), F.max("component").alias("y"))
    return labelled.join(staged(several.where("x < y").drop("x", "y"), "several"), "band")


def few_mates(mixed: DataFrame, p: SetSketch) -> DataFrame:
    """(a, b): band mates of different components and of sizes that the threshold allows."""
    x, y = (mixed.select("band", F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("component").alias(f"c{s}")) for s in "ab")
    met = x.join(y, "band").where(f"a < b AND ca != cb AND 100 * na >= {p.percent} * nb AND 100 * nb >= {p.percent} * na")
    return met.select("a", "b").distinct()


def block_links(mixed: DataFrame, texts: DataFrame, p: SetSketch) -> DataFrame:
    """(a, b): links that join the components within large bands.

    A band's members are dealt to blocks by a hash of their ids; every two blocks
    meet in one task, of bounded size. A pair is compared in the first band that
    it shares.
    """
    blocks = F.ceil(F.greatest(F.col("m") / p.block, F.col("shingles") / p.block_shingles)).cast("long")
    own = F.pmod(F.xxhash64("id", "band"), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = mixed.select("band", "id", "component", own.alias("own"), other.alias("other"))
    met = dealt.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "component", "own").join(texts, "id")
    met = met.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "id")

    def compared(band: int, x: int, y: int, ids: list, parts: list, owns: list, words: list) -> Iterator[tuple[int, int]]:
        raw = [w.encode() for w in words]
        sets, at = sets_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), p.k)
        n, registers = np.diff(at), register_values(sets, at, p)
        keys, owns = band_keys(registers, p), np.array(owns)
        own = np.array(parts)
        for i in range(len(ids)):
            j = np.arange(i + 1, len(ids))
            j = j[own[j] != own[i]]
            if x != y:
                j = j[owns[j] != owns[i]]
            j = j[100 * np.minimum(n[j], n[i]) >= p.percent * np.maximum(n[j], n[i])]
            same = keys[j] == keys[i]
            j = j[same.any(1) & (keys[i][same.argmax(1)] == band)] if len(j) else j
            if not len(j):
                continue
            best, ok = estimate(np.broadcast_to(registers[i], (len(j), p.registers)), registers[j], np.full(len(j), float(n[i])), n[j].astype(np.float64), p)
            for k in j[ok][np.argsort(-best[ok], kind="stable")]:
                a, b = own[i], own[k]
                if a != b and linked(sets[at[i] : at[i + 1]], sets[at[k] : at[k + 1]], p.percent):
                    own[own == max(a, b)] = min(a, b)
                    yield ids[i], ids[k]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    found += compared(*key, *zip(*held, strict=True)) if held else []
                    key, held = row[:3], []
                held.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        if held:
            found = list(compared(*key, *zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return met.select("band", "x", "y", "id", "component", "own", "text").mapInArrow(work, "a long, b long")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, 3-word shingles, 85 of 100."""
    found = near_duplicates(table(spark, sf_dir, "documents"), SetSketch(k=3, percent=85))
    return found.drop("key").withColumnRenamed("id", "doc_id")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 3 THEN w[i:i+2] ELSE w END AS s
  FROM words, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
-- documents of one set are one class; classes are compared by their rarer shingles
sets AS (SELECT doc_id, md5(string_agg(array_to_string(s, ' '), chr(10) ORDER BY array_to_string(s, ' '))) AS m FROM shingles GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY m) AS c FROM sets),
reps AS (SELECT s.doc_id, s.s FROM shingles s JOIN class USING (doc_id) WHERE doc_id = c),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM reps a JOIN reps b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a, least(a, min(b)) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, c, d.doc_id) AS component_id, coalesce(m, c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN class USING (doc_id) LEFT JOIN least ON least.a = class.c
"""
