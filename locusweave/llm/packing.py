"""Packing token sequences by cutting-stock column generation.

Documents become token ids; what exceeds the room of a sequence is cut off as
full pieces, and the rest of each document is one item. Items of a length class
(lengths rounded up to `step`) are interchangeable, so the program needs their
histogram only: a linear program over patterns (how many items of each class
share a sequence), whose columns are priced by knapsack dynamic programming.
Patterns are used a whole number of times; the few items that rounding leaves
are packed by first fit. The pieces, ranked within their class, then take the
places that the patterns offer, and offsets add up real lengths, without gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged, table, utf8
from .tokens import document_ids


@dataclass(frozen=True)
class Packing:
    """room: tokens of a sequence; step: width of a length class; gap: share by
    which the linear program may exceed its bound; end_id: id after each document;
    pad_id: id of padding; ranked: pieces of one class ranked in one task."""

    room: int = 2048
    step: int = 8
    gap: float = 2e-4
    end_id: int = 1
    pad_id: int = 0
    ranked: int = 2_000


def best_pattern(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes 1..n of widths 1..n within the room."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        w = min(c, len(values))
        with_last = values[:w] + best[c - w : c][::-1]
        k = int(with_last.argmax())
        if with_last[k] > best[c - 1] + 1e-12:
            best[c], last[c] = with_last[k], k + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(values), np.int64), room
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[room]), counts


def linear_program(demand: np.ndarray, room: int, gap: float, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, with which sequences are fewest up to `gap`.

    demand: items of the widths 1, 2, ... Column generation by the revised
    simplex method, from patterns of one width each; only widths in demand occur.
    """
    used = np.flatnonzero(demand > 0)
    d, m = demand[used].astype(float), len(used)
    each = room // (used + 1)
    patterns = np.diag(each).astype(float)
    inverse, x, cost = np.diag(1.0 / each), d / each, np.ones(m)
    for _ in range(most):
        y = cost @ inverse
        if y.min() < -1e-9:  # some width is cut more often than asked for
            enter, price = np.zeros(m), 0.0
            enter[y.argmin()] = -1.0
        else:
            values = np.zeros(used[-1] + 1)
            values[used] = np.maximum(y, 0)
            worth, counts = best_pattern(values, room)
            if worth <= 1 + 1e-9 or x @ cost - (y @ d) / worth <= gap * (x @ cost):
                break
            enter, price = counts[used].astype(float), 1.0
        direction = inverse @ enter
        up = direction > 1e-9
        ratios = np.where(up, x / np.where(up, direction, 1), np.inf)
        out = int(ratios.argmin())
        x = np.maximum(x - ratios[out] * direction, 0)
        x[out] = ratios[out]
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[out], cost[out] = enter, price
    real = cost > 0
    found = np.zeros((int(real.sum()), len(demand)), np.int64)
    found[:, used] = patterns[real].round().astype(np.int64)
    return found, x[real]


def first_fit(items: np.ndarray, room: int) -> list[np.ndarray]:
    """First fit of decreasing widths; items[w - 1]: items of width w."""
    left, packed = np.zeros(0, np.int64), []
    for w in range(len(items), 0, -1):
        for _ in range(int(items[w - 1])):
            fits = np.flatnonzero(left >= w)
            if len(fits):
                k = int(fits[0])
            else:
                k, left = len(left), np.append(left, room)
                packed.append(np.zeros(len(items), np.int64))
            left[k] -= w
            packed[k][w - 1] += 1
    return packed


def whole_patterns(demand: np.ndarray, room: int, gap: float) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that pack each item exactly once: patterns rounded down, the rest by first fit."""
    left, plan = demand.astype(np.int64).copy(), []
    if left.any():
        patterns, times = linear_program(left, room, gap)
        for pattern, x in sorted(zip(patterns, times, strict=True), key=lambda p: -p[1]):
            n = min(int(x + 1e-6), *(left[pattern > 0] // pattern[pattern > 0]).tolist())
            if n > 0:
                plan.append((pattern, n))
                left -= n * pattern
    return plan + [(p, 1) for p in first_fit(left, room)]


def places(plan: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks: class, first rank, first sequence, items a sequence and first slot, sorted by class and rank."""
    rows, seen, sequence = [], {}, 0
    for pattern, times in plan:
        slot = 0
        for k in np.flatnonzero(pattern).tolist():
            count = int(pattern[k])
            rows.append((k + 1, seen.get(k, 0), sequence, count, slot))
            seen[k] = seen.get(k, 0) + count * times
            slot += count
        sequence += times
    return dict(zip(("kind", "rank", "sequence", "count", "slot"), np.array(sorted(rows), np.int64).reshape(-1, 5).T, strict=True))


PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, p: Packing, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: full pieces first, then the rest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = (*[pa.int64()] * 5, pa.binary()), [x.split()[0] for x in PIECE.split(", ")]
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(np.diff(offsets)):
                rows = []
                own = document_ids(tokenizer, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p.end_id)
                for key, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), own, strict=True):
                    for at in range(0, len(ids), p.room):
                        cut = ids[at : at + p.room].tobytes()
                        rows.append((key, at, len(cut) // 4, zlib.crc32(cut), len(ids), cut if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, PIECE)


def ranked(found: DataFrame, p: Packing) -> DataFrame:
    """found plus `kind` (length class) and `rank` within it, from 0 without gaps; large classes are ranked in parts."""
    n = found.count()
    parts = max(1, -(-n // p.ranked))
    dealt = found.withColumn("kind", F.ceil(F.col("length") / p.step)).withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(parts)))
    counts = dealt.groupBy("kind", "part").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    starts = counts.withColumn("before", before).drop("m")
    own = F.row_number().over(Window.partitionBy("kind", "part").orderBy(F.desc("length"), "id", "start", "ids_crc32"))
    return dealt.withColumn("own", own).join(starts, ["kind", "part"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("own", "before", "part")


def placed(found: DataFrame, p: Packing) -> DataFrame:
    """found (with a column length) plus sequence_id and offset."""
    if p.room % p.step:
        raise ValueError("the room must be a multiple of the step")
    found = staged(found, "pieces")
    kind = F.ceil(F.col("length") / p.step).cast("int").alias("kind")
    classes, columns = p.room // p.step, found.columns
    demand = np.zeros(classes, np.int64)
    for k, n in found.groupBy(kind).count().collect():  # as many rows as classes at most
        demand[k - 1] = n
    full = demand[-1]
    demand[-1] = 0
    plan = whole_patterns(demand, classes, p.gap)
    if full:
        plan.append((np.eye(1, classes, classes - 1, dtype=np.int64)[0], int(full)))
    at = places(plan)
    keys = (at["kind"] << 44) + at["rank"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("kind", "rank"))
            k = np.searchsorted(keys, (kind << 44) + rank, "right") - 1
            into = rank - at["rank"][k]
            sequence, slot = at["sequence"][k] + into // at["count"][k], at["slot"][k] + into % at["count"][k]
            rest = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sequence), pa.array(slot)], [*columns, "sequence_id", "slot"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in [*found.dtypes, ("sequence_id", "long"), ("slot", "long")])
    seated = ranked(found, p).mapInArrow(work, kinds)
    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seated.withColumn("offset", F.sum("length").over(in_order) - F.col("length")).drop("slot")


def packed(docs: DataFrame, p: Packing = Packing(), tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset) for each piece of all documents.

    A null or empty text has one id, end_id. Long texts are cut every `room` ids.
    Null and repeated ids and repeated rows are packed as documents of their own.
    No other column is read. An empty table gives no rows. ids: little-endian
    unsigned 32-bit numbers.
    """
    found = pieces(docs, p, tokenizer or default_tokenizer(), id_col, text_col, with_ids)
    return placed(found if with_ids else found.drop("ids"), p)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def sequences(pieces_: DataFrame, p: Packing = Packing()) -> DataFrame:
    """(sequence_id, tokens, ids) of packed(with_ids=True): ids padded to the room, except at a power of two."""
    whole = pieces_.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, b: F.concat(a, b))
    pad = F.lit(np.uint32(p.pad_id).astype("<u4").tobytes())
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return whole.select("sequence_id", "tokens", F.when(power, joined).otherwise(F.rpad(joined, 4 * p.room, pad)).alias("ids"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed into sequences of 2048."""
    return packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
