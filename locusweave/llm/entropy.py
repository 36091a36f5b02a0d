"""Cross-entropy difference of documents under matched target and background models.

Both are trigram models over one vocabulary, every word of all documents: a
trigram's estimate is smoothed by the bigram's, that by the word's and that by an
even share. They are smoothed alike, a document's own counts are left out of
both, and a document's score is the mean over its words of target loss minus
background loss; lower is nearer the target.

Counts cover all documents. Documents lie in blocks of bounded size. Each block
lists its distinct words, bigrams and trigrams with their counts by hash (`BITS`
bits) and sends them to buckets, ranges of hashes whose number grows with the
corpus. A bucket adds up what its blocks have and tells each block how often its
keys stand elsewhere, so all that travels are sorted hashes and small counts,
and no table of all n-grams is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, table, utf8
from .words import mix, spans, word_hashes

#: Bits of the hashes of words, bigrams and trigrams; the lowest one marks words.
BITS = 52


@dataclass(frozen=True)
class Difference:
    """bigram_mass, trigram_mass: weights of the estimate below in that of a bigram
    and a trigram; part: how many times a word more than it is met each word
    counts; block: bytes of text of a block, on average, unless one text is longer;
    bucket: distinct keys that blocks send to a bucket, on average; ids_broadcast:
    ids of the target that are broadcast, at most."""

    bigram_mass: float = 4.0
    trigram_mass: float = 1.0
    part: float = 0.5
    block: int = 3 << 20
    bucket: int = 500_000
    ids_broadcast: int = 1_000_000


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, all lowest bytes first, compressed; the number of bytes that are used leads."""
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([used]) + (pa.compress(raw[:, :used].T.tobytes(), "zstd", asbytes=True) if used else b"")


def numbers(raw: bytes, n: int) -> np.ndarray:
    """What `planes` was given, n numbers."""
    out, used = np.zeros((n, 8), np.uint8), raw[0]
    if used:
        out[:, :used] = np.frombuffer(pa.decompress(raw[1:], n * used, "zstd", asbytes=True), np.uint8).reshape(used, n).T
    return out.view("<u8").ravel()


BLOCKS = "block long, ids array<long>, targets binary, ends binary, size long, body binary"


def blocked(rows: DataFrame, p: Difference) -> DataFrame:
    """rows (id, text, target) in blocks, a row each: runs of about p.block bytes within a partition, compressed."""

    def packed(block: int, held: list[tuple]) -> pa.RecordBatch:
        body = b"".join(h[2].tobytes() for h in held)
        ends = np.cumsum(np.concatenate([h[3] for h in held]))
        ids = pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.concat_arrays([h[0] for h in held]))
        targets = np.concatenate([h[1] for h in held]).astype(np.uint8).tobytes()
        columns = [pa.array([block]), ids, *(pa.array([x], pa.binary()) for x in (targets, ends.astype("<i8").tobytes())), pa.array([len(body)]), pa.array([pa.compress(body, "zstd", asbytes=True)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            target = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in slices(np.diff(offsets), p.block // 4):
                if held and size + offsets[j] - offsets[i] > p.block:
                    yield packed(block, held)
                    block, held, size = block + 1, [], 0
                # copies, so that the batch can go
                held.append((pa.array(batch.column(0).slice(i, j - i).to_pylist(), pa.int64()), target[i:j].copy(), data[offsets[i] : offsets[j]].copy(), np.diff(offsets[i : j + 1])))
                size += int(offsets[j] - offsets[i])
        if held:
            yield packed(block, held)

    return staged(rows.select("id", "text", "target").mapInArrow(work, BLOCKS), "blocks")


def grams(body: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words, bigrams and trigrams (in this order, each by place), their rows, and the word offsets of rows."""
    data, offsets = np.frombuffer(body, np.uint8), np.concatenate([[0], ends])
    starts, stops, at = spans(data, offsets)
    w = word_hashes(data, starts, stops)
    row = np.repeat(np.arange(len(ends)), np.diff(at))
    two, three = row[1:] == row[:-1], row[2:] == row[:-2]
    factor, shift = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - BITS)
    pair = mix(w[:-1] * factor + w[1:])
    triple = mix(pair[:-1] * factor + w[2:])
    one = np.uint64(1)
    keys = np.concatenate([(mix(w) >> shift) | one, (pair[two] >> shift) & ~one, (triple[three] >> shift) & ~one])
    return keys, np.concatenate([row, row[1:][two], row[2:][three]]), at


REQUESTS = "bucket long, block long, m long, keys binary, n binary, t binary"


def asked(blocks: DataFrame, buckets: int) -> DataFrame:
    """A row for each block and bucket: the block's distinct keys in it, sorted, as steps from the bucket's edge, and their counts in all and in target documents."""
    edges = np.array([(b << BITS) // buckets & ~1 for b in range(buckets)], np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in REQUESTS.split(", ")]
        for batch in batches:
            for block, targets, ends, size, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "targets", "ends", "size", "body")), strict=True):
                keys, row, _ = grams(pa.decompress(body, size, "zstd", asbytes=True), np.frombuffer(ends, "<i8"))
                keys = 2 * keys + np.frombuffer(targets, np.uint8)[row]
                del row
                both, count = np.unique(keys, return_counts=True)
                key, first = np.unique(both >> np.uint64(1), return_index=True)
                if not len(key):
                    continue
                n, t = np.add.reduceat(count, first), np.add.reduceat(np.where(both & np.uint64(1), count, 0), first)
                cut = [*np.searchsorted(key, edges).tolist(), len(key)]
                found = [(b, i, j) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
                columns = [[b for b, _, _ in found], [block] * len(found), [j - i for _, i, j in found], [planes(np.diff(key[i:j], prepend=edges[b])) for b, i, j in found], *([planes(x[i:j]) for _, i, j in found] for x in (n, t))]
                kinds = (*[pa.int64()] * 3, *[pa.binary()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return blocks.select("block", "targets", "ends", "size", "body").mapInArrow(work, REQUESTS)


ANSWERS = "block long, bucket long, m long, some binary, n binary, t binary, words long, tokens long, target_tokens long"


def answered(requests: DataFrame) -> DataFrame:
    """For each request which of its keys stand in other blocks, and how often; a bucket's first answer counts its words."""

    def work(rows: pa.Table) -> pa.Table:
        rows = {c: rows.column(c).to_pylist() for c in rows.column_names}
        sizes = rows["m"]
        keys = np.concatenate([np.cumsum(numbers(k, m)) for k, m in zip(rows["keys"], sizes, strict=True)])
        n, t = (np.concatenate([numbers(x, m) for x, m in zip(rows[c], sizes, strict=True)]).astype(np.int64) for c in ("n", "t"))
        distinct, of = np.unique(keys, return_inverse=True)
        is_word = (keys & np.uint64(1)).astype(bool)
        whole = [int((distinct & np.uint64(1)).sum()), int(n[is_word].sum()), int(t[is_word].sum())]
        del keys, distinct, is_word
        more = [np.bincount(of, x).astype(np.int64)[of] - x for x in (n, t)]
        stops = np.cumsum(sizes)
        out = []
        for block, bucket, i, j in zip(rows["block"], rows["bucket"], (stops - sizes).tolist(), stops.tolist(), strict=True):
            some = more[0][i:j] > 0
            out.append((block, bucket, j - i, np.packbits(some).tobytes(), planes(more[0][i:j][some]), planes(more[1][i:j][some]), *whole))
            whole = [0, 0, 0]
        kinds = (*[pa.int64()] * 3, *[pa.binary()] * 3, *[pa.int64()] * 3)
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in ANSWERS.split(", ")])

    return requests.groupBy("bucket").applyInArrow(work, ANSWERS)


def elsewhere(answers: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """How often a block's keys, sorted, stand in other blocks, in all and in target documents."""
    parts = []
    for k in np.argsort(answers["bucket"]).tolist():
        some = np.unpackbits(np.frombuffer(answers["some"][k], np.uint8), count=answers["m"][k]).astype(bool)
        part = np.zeros((2, len(some)), np.int64)
        for x, c in zip(part, ("n", "t"), strict=True):
            x[some] = numbers(answers[c][k], int(some.sum()))
        parts.append(part)
    return tuple(np.concatenate(parts, 1)) if parts else (np.zeros(0, np.int64),) * 2


def losses(counts: tuple[np.ndarray, ...], at: np.ndarray, all_: float, words: float, p: Difference) -> np.ndarray:
    """Loss of each word; counts: of the word, bigram and trigram that ends at each place, without what is left out.

    The ends of documents count as words that follow, so the counts of a word are
    those of its histories. A row's first word has no bigram, its second no trigram.
    """
    one, two, three = counts
    place = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    estimate = (one + p.part) / (all_ + p.part * max(words, 1))
    estimate = np.where(place > 0, (two + p.bigram_mass * estimate) / (before(one) + p.bigram_mass), estimate)
    estimate = np.where(place > 1, (three + p.trigram_mass * estimate) / (before(two) + p.trigram_mass), estimate)
    return -np.log(estimate)


SCORE = "id long, tokens long, target_loss double, background_loss double, score double"


def scored_block(body: bytes, ends: np.ndarray, target: np.ndarray, answers: dict[str, list], whole: tuple[int, int, int], p: Difference) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and target and background loss of each document of a block; whole: distinct words, and words in all and in target documents."""
    keys, row, at = grams(body, ends)
    size = int(at[-1])
    place = np.arange(size) - np.repeat(at[:-1], np.diff(at))
    # a stable order by key keeps the rows of a key together
    order = np.argsort(keys, kind="stable")
    key, of_row = keys[order], row[order].astype(np.int32)
    del keys, row
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    both = new.copy()
    both[1:] |= of_row[1:] != of_row[:-1]
    of_key, of_both = np.cumsum(new, dtype=np.int32) - 1, np.cumsum(both, dtype=np.int32) - 1
    own = np.bincount(of_both)[of_both] if len(key) else np.zeros(0, np.int64)
    is_target = target[of_row]
    del of_both, of_row, new, both
    n = np.bincount(of_key) if len(key) else np.zeros(0, np.int64)
    t = np.bincount(of_key, is_target).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    other = elsewhere(answers)
    if len(other[0]) != len(n):
        raise RuntimeError(f"{len(other[0])} answers for {len(n)} keys")
    each = np.diff(at)
    means = []
    for mine, more, out, all_ in ((t, other[1], is_target, whole[2]), (n, other[0], np.ones(len(key), bool), whole[1])):
        flat = np.empty(len(key))
        flat[order] = (mine + more)[of_key] - np.where(out, own, 0)
        counts, i = [], 0
        for least in range(3):
            full, of = np.zeros(size), place >= least
            j = i + int(of.sum())
            full[of], i = flat[i:j], j
            counts.append(full)
        without = np.where(np.ones(len(ends), bool) if mine is n else target > 0, each, 0)
        total = np.concatenate([[0.0], np.cumsum(losses(tuple(counts), at, np.repeat(all_ - without, each).astype(float), whole[0], p))])
        means.append((total[at[1:]] - total[at[:-1]]) / np.maximum(each, 1))
    return each, *means


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, p: Difference = Difference(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, target_loss, background_loss, score) for each row of docs; losses are means in nats.

    target_ids: one column of that name, the documents that the target model is
    made of; nulls and repeats in it change nothing. A text without words (null,
    empty, white space) has 0 tokens and null losses. Null ids and repeated rows
    are scored and counted as documents of their own. Other columns are not read.
    An empty table gives no rows; without target documents the target model is flat.
    """
    chosen = target_ids.select(F.col(id_col).cast("long").alias("_target")).where("_target IS NOT NULL").distinct()
    few = chosen.limit(p.ids_broadcast + 1).count() <= p.ids_broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen) if few else chosen, F.col("id") == F.col("_target"), "left")
    blocks = blocked(rows.select("id", "text", F.col("_target").isNotNull().alias("target")), p)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    # a byte of text makes a quarter of a key
    answers = staged(answered(asked(blocks, max(1, -(-size // (4 * p.bucket))))), "answers")
    whole = tuple(int(x or 0) for x in answers.agg(F.sum("words"), F.sum("tokens"), F.sum("target_tokens")).first())

    def score(block: pa.Table, answer: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCORE.split(", ")]
        if not block.num_rows:
            return pa.Table.from_arrays([pa.array([], kind) for kind in (*[pa.int64()] * 2, *[pa.float64()] * 3)], names)
        ids, targets, ends, size, body = (block.column(c)[0].as_py() for c in ("ids", "targets", "ends", "size", "body"))
        body = pa.decompress(body, size, "zstd", asbytes=True)
        n, *means = scored_block(body, np.frombuffer(ends, "<i8"), np.frombuffer(targets, np.uint8), {c: answer.column(c).to_pylist() for c in answer.column_names}, whole, p)
        empty = n == 0
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(n), *(pa.array(x, mask=empty) for x in (*means, means[0] - means[1]))], names)

    return blocks.groupBy("block").cogroup(answers.drop("words", "tokens", "target_tokens").groupBy("block")).applyInArrow(score, SCORE)


def op6_cross_entropy(spark, sf_dir: str) -> DataFrame:
    """All documents against a target model of those rated good and not toxic."""
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    found = cross_entropy_difference(table(spark, sf_dir, "documents"), good.where("quality = 1 AND toxic = 0"))
    return found.withColumnRenamed("id", "doc_id")
