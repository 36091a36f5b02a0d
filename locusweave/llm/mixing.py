"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is made of blocks of equal numbers of words. Every source is dealt to
shards by a seeded hash, and each shard's documents, in seeded order, form one
run of words that is cut to blocks. The mix's blocks are seats, allotted one at
a time to the (source, shard) of the highest quotient votes / (2 * seats + 1),
which gives each shard an integer quota. A shard then takes all its blocks as
often as the quota allows and a seeded choice of them once more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import byte_lengths, looked_up, numbered, slices, staged, table

WORD = r"[^\x20\x09-\x0D]+"
#: A prime that deals block numbers out evenly.
STEP = 2654435761


@dataclass(frozen=True)
class Mix:
    """Parameters. Weights repeat over the sources in code-point order, null last.

    share: words of the mix per word of the input; most: times a source (and so a
    document) may be taken; block: words of a block; shard_docs: documents of a
    source in one shard, on average; near: quotients that are ranked one by one.
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: int = 2
    block: int = 64
    shard_docs: int = 4000
    seed: int = 17
    near: int = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, p: Mix) -> DataFrame:
    """(source, a, size, docs, weight, target) of the table (source, size, docs); a numbers the sources in order.

    The mix is shared by weight; what exceeds `most` times a source's size is
    shared again by weight among the others, until none exceeds it.
    """
    ordered = numbered(sources.withColumn("missing", F.col("source").isNull()), ["missing", "source"], "a").drop("missing")
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    weight = F.element_at(weights, (F.col("a") % len(p.weights) + 1).cast("int"))
    now = staged(ordered.withColumn("weight", weight).withColumn("top", F.lit(float(p.most)) * F.col("size")), "sources")
    words, open_ = now.agg(F.sum("size"), F.sum("weight")).first()
    level, full = p.share * (words or 0) / (open_ or 1.0), 0
    while True:
        capped = F.col("top") < F.lit(level) * F.col("weight")
        n, taken, weight = now.agg(F.count_if(capped), F.sum(F.when(capped, F.col("top"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == full or not weight:
            break
        level, full = (p.share * words - taken) / weight, n
    return now.withColumn("target", F.least(F.col("top"), F.lit(level) * F.col("weight"))).drop("top")


def apportioned(parties: DataFrame, votes: str, seats: int, near: int = 4096, width: int = 64) -> DataFrame:
    """parties (keyed by the columns a, b) plus `quota`: seats by highest quotients votes / (2k - 1), ties by a, b.

    No table of all seats is made: a search narrows down the last quotient that
    wins, each step being one aggregation over the parties, until at most `near`
    quotients are left to be ranked. Parties without votes get no seat.
    """
    parties = staged(parties, "parties")
    top = parties.agg(F.max(votes)).first()[0] or 0.0
    if seats <= 0 or top <= 0:
        return parties.withColumn("quota", F.lit(0).cast("long"))

    def won(least: float) -> Column:
        """Seats whose quotients are at least so high."""
        return F.floor((F.col(votes) / F.lit(least) + 1) / 2).cast("long")

    low, high, above, below = top / (2.0 * seats + 1), top * 1.001, 0, None
    while below is None or (below - above > near and high / low - 1 > 1e-12):
        grid = [low, *np.geomspace(low, high, width)[1:-1].tolist(), high]
        sums = parties.agg(*[F.sum(won(x)).alias(f"s{i}") for i, x in enumerate(grid)]).first()
        last = max(i for i, s in enumerate(sums) if s >= seats)
        low, high, below, above = grid[last], grid[min(last + 1, len(grid) - 1)], sums[last], sums[min(last + 1, len(grid) - 1)]
    sure = parties.withColumn("sure", won(high)).withColumn("more", won(low) - F.col("sure"))
    edge = sure.where("more > 0").select("a", "b", votes, F.explode(F.expr("sequence(sure + 1, sure + more)")).alias("k"))
    chosen = edge.orderBy((F.col(votes) / (2 * F.col("k") - 1)).desc(), "a", "b", "k").limit(int(seats - above))
    extra = chosen.groupBy("a", "b").agg(F.count("*").alias("extra"))
    return sure.join(extra, ["a", "b"], "left").withColumn("quota", F.col("sure") + F.coalesce("extra", F.lit(0))).drop("sure", "more", "extra")


def mixed(docs: DataFrame, p: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None) -> DataFrame:
    """(row, size, source_size, target, blocks) for each row of docs; row has all its columns.

    blocks: array of (first word, end, times) of the document's share of each
    block. A null or empty text, or one of white space only, has size 0 and no
    blocks. A null source is a source, the last in order. Null and repeated ids
    and repeated rows are mixed as documents of their own. Sizes can be given in
    a column instead of texts. An empty table gives no rows.
    """
    size = F.col(size_col) if size_col else word_count(F.col(text_col).cast("string"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), F.xxhash64(F.lit(p.seed), F.col(id_col), F.col(size_col or text_col)).alias("key"))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")), p)
    sources = staged(sources, "targets").select("source", "a", F.col("size").alias("source_size"), "target", F.ceil(F.col("docs") / p.shard_docs).alias("shards"))
    dealt = looked_up(rows, sources, "source", "key").withColumn("b", F.pmod(F.xxhash64("key"), F.col("shards")))
    shards = dealt.groupBy("a", "b").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0)
    shards = shards.select("a", "b", "words", votes.alias("votes"), F.ceil(F.col("words") / p.block).alias("n"))
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    quotas = apportioned(shards, "votes", round(total / p.block), p.near).select("a", "b", "n", F.least("quota", p.most * F.col("n")).alias("quota"))

    before = F.sum("size").over(Window.partitionBy("a", "b").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = dealt.withColumn("start", before).join(quotas, ["a", "b"])
    block = F.lit(p.block).cast("long")
    shift = F.pmod(F.xxhash64("a", "b", F.lit(p.seed)), F.col("n"))

    def share(i: Column) -> Column:
        first, end = F.greatest(i * block, F.col("start")), F.least((i + 1) * block, F.col("start") + F.col("size"))
        again = F.pmod(i * F.lit(STEP) + F.col("shift"), F.col("n")) < F.col("quota") % F.col("n")
        return F.struct((first - F.col("start")).alias("first"), (end - F.col("start")).alias("end"), (F.floor(F.col("quota") / F.col("n")) + again.cast("long")).alias("times"))

    from_, to = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    placed = placed.withColumn("shift", shift)
    blocks = F.when(F.col("size") > 0, F.transform(F.sequence(from_, to), share)).otherwise(F.expr("array()"))
    return placed.select("row", "size", "source_size", "target", blocks.alias("blocks"))


def taken(blocks: Column) -> Column:
    """Words that the mix takes of a document, repeats counted."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["first"]) * x["times"])


def mixed_texts(docs: DataFrame, p: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, with the columns of docs: a row for each copy of what is taken of a document.

    Copy r has the words of the blocks taken r times or more; a copy of all words
    is the text as it was, otherwise the runs of words, each as it stood, are
    joined by a line break. What the mix doesn't take has no row, nor has a null or
    empty text or one without words. Other columns of any type and name pass as
    they are. Repeated rows and null ids are documents of their own; ties in the
    seeded order go by id and size. An empty table gives no rows.
    """
    words = re.compile(WORD)
    columns = docs.columns

    def copies(text: str, first: list[int], end: list[int], times: list[int]) -> Iterator[str]:
        spans = None
        for r in range(1, max(times, default=0) + 1):
            if min(times) >= r:
                yield text
                continue
            spans = spans or [m.span() for m in words.finditer(text)]
            runs: list[list[int]] = []
            for a, b, t in zip(first, end, times, strict=True):
                if t >= r:
                    if runs and runs[-1][1] == a:
                        runs[-1][1] = b
                    else:
                        runs.append([a, b])
            yield "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(byte_lengths(batch.column(1))):
                part = batch.slice(i, j - i)
                made = [list(copies(*row)) for row in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                of = np.repeat(np.arange(j - i), [len(x) for x in made])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array([x for row in made for x in row], pa.string())], ["_row", "_text"])

    found = mixed(docs, p, id_col, text_col, source_col).where(F.size("blocks") > 0)
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"row.`{c}`").alias(c) for c in columns if c != text_col])
    slim = found.select(rest.alias("_row"), F.col(f"row.`{text_col}`").alias("_text"), *[F.col(f"blocks.{x}").alias(f"_{x}") for x in ("first", "end", "times")])
    schema = StructType([StructField("_row", slim.schema["_row"].dataType), StructField("_text", StringType())])
    cut = slim.mapInArrow(work, schema)
    return cut.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents mixed; the words taken of each."""
    sizes = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = mixed(staged(sizes, "sizes"), size_col="size")
    return out.select("row.doc_id", "size", "source_size", "target", taken(F.col("blocks")).alias("taken"))
