"""Resharding at least cost: which bytes move from old shards to new ones, and which files are written anew.

A table's files belong to old shards. Their sizes and the capacities of the new
shards make a transport problem, whose minimum-cost flow says how many bytes go
from where to where; what can stay in its shard stays. A flow is cut out of the
old shard's documents in their order, so it is whole blocks of documents but for
those at its two ends. Long documents would make ends uneven; they are placed
one by one beforehand, of which there are at most LONG for a new shard. Only
files that lose a document are read and written again; all others stay where
they are, and a manifest says which files make a shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.storage import own_dir

from .common import looked_up, staged, table

SHARDS = 16
#: Rows of a block, the unit that sizes are added up in.
BLOCK_ROWS = 512
#: A document is long if it takes more than 1 / LONG of the smallest new shard.
LONG = 128
#: Files that a broadcast manifest lists at most.
MANIFEST_ROWS = 500_000


def flow(supply: list[int], demand: list[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """{(i, j): amount} that sends all supplies at the least cost, by successive shortest paths; demands add up to the supplies.

    The network has a node a shard, so it is small whatever the table's size.
    """
    if sum(supply) != sum(demand):
        raise ValueError(f"supplies of {sum(supply)} and demands of {sum(demand)}")
    n, m = len(supply), len(demand)
    costs = np.array([[cost(i, j) for j in range(m)] for i in range(n)], np.int64).reshape(n, m)
    sent, left, open_ = np.zeros((n, m), np.int64), np.array(supply, np.int64), np.array(demand, np.int64)
    far = np.iinfo(np.int64).max // 4
    while left.any():
        # least cost to each old shard (by taking back what it sends) and to each new one, from any that has something left
        old, new, over, back = np.where(left > 0, 0, far), np.full(m, far), np.full(m, -1), np.full(n, -1)
        while True:
            ways = old[:, None] + costs
            better = ways.min(0) < new
            over[better], new[better] = ways.argmin(0)[better], ways.min(0)[better]
            returns = np.where(sent > 0, new[None] - costs, far)
            nearer = returns.min(1) < old
            back[nearer], old[nearer] = returns.argmin(1)[nearer], returns.min(1)[nearer]
            if not nearer.any():
                break
        j = int(np.where(open_ > 0, new, far).argmin())
        path, end = [], j
        while True:
            i = int(over[end])
            path.append((i, end, 1))
            if back[i] < 0:
                break
            end = int(back[i])
            path.append((i, end, -1))
        start = path[-1][0]
        amount = min(int(left[start]), int(open_[j]), *[int(sent[i, k]) for i, k, sign in path if sign < 0])
        for i, k, sign in path:
            sent[i, k] += sign * amount
        left[start] -= amount
        open_[j] -= amount
    return {(int(i), int(j)): int(sent[i, j]) for i, j in np.argwhere(sent > 0)}


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares of all bytes; what is left over goes to the first shards, a byte each."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def placed(long: list[tuple[int, int]], capacity: list[int]) -> tuple[list[int], list[int]]:
    """New shards of long documents (size, old shard), given largest first, and what is left of the capacities.

    A document stays in its shard if it fits there, and goes to the emptiest if not.
    """
    free, out = list(capacity), []
    for size, old in long:
        j = old if old < len(free) and size <= free[old] else max(range(len(free)), key=lambda k: (free[k], -k))
        out.append(j)
        free[j] -= size
    return out, free


def levelled(free: list[int]) -> list[int]:
    """Capacities without negative ones, left where a document exceeds a shard: the others give up equal shares for them."""
    while min(free, default=0) < 0:
        short, open_ = -sum(x for x in free if x < 0), [k for k, x in enumerate(free) if x > 0]
        free = [max(x, 0) for x in free]
        for k, part in zip(open_, capacities(short, len(open_)), strict=True):
            free[k] -= part
    return free


def files_of(docs: DataFrame, old_shards: int) -> DataFrame:
    """(path, shard, number) of the files that a table read from Parquet has rows in: file k, in order of paths, belongs to old shard k mod old_shards."""
    files = docs.select(F.col("_metadata.file_path").alias("path")).distinct()
    number = (F.row_number().over(Window.orderBy("path")) - 1).cast("long")
    return staged(files.withColumn("number", number).withColumn("shard", (F.col("number") % old_shards).cast("int")), "files")


def plan(docs: DataFrame, manifest: DataFrame, shards: int = SHARDS, text_col: str = "text", block: int = BLOCK_ROWS) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(path, shard, runs) for each file with rows, and the flow; runs: array of (first row, new shard) in order.

    docs has been read from the manifest's files by Parquet. A row's size is the
    bytes of its text in UTF-8 plus 1; a null text has none.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), size.alias("size"))
    rows = staged(rows.withColumn("block", F.floor(F.col("at") / block)), "sizes")
    blocks = staged(rows.groupBy("path", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("longest")), "blocks")
    files = looked_up(blocks.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")), manifest, "path", "path", MANIFEST_ROWS)
    files = staged(files, "files")
    sizes = {r[0]: r[1] for r in files.groupBy("shard").agg(F.sum("bytes")).collect()}
    total = sum(sizes.values())
    capacity = capacities(total, shards)
    least = max(capacity[-1], 1) / LONG

    # at most LONG documents a new shard, by their size
    shard_of = looked_up(rows.join(blocks.where(F.col("longest") > least).select("path", "block"), ["path", "block"], "left_semi").where(F.col("size") > least), files.select("path", "shard"), "path", "at", MANIFEST_ROWS)
    long = shard_of.orderBy(F.desc("size"), "path", "at").collect()
    where, free = placed([(r["size"], r["shard"]) for r in long], capacity)
    spark = docs.sparkSession
    taken = spark.createDataFrame([(r["path"], r["at"], r["block"], r["size"], j) for r, j in zip(long, where, strict=True)], "path string, at long, block long, size long, target int")
    rest = [sizes.get(i, 0) - sum(r["size"] for r in long if r["shard"] == i) for i in range(max([shards - 1, *sizes]) + 1)]
    free = levelled(free)
    sent = flow(rest, free)

    # an old shard's documents in order: first those that stay, then those for each new shard
    ends = {}
    for i in range(len(rest)):
        mine = sorted(((j != i, j, x) for (k, j), x in sent.items() if k == i), key=lambda r: r[:2])
        ends[i] = ([int(x) for x in np.cumsum([x for *_, x in mine])], [j for _, j, _ in mine])
    borders = spark.createDataFrame([(i, [*map(int, a)], b) for i, (a, b) in ends.items()], "shard int, ends array<long>, targets array<int>")
    out = taken.groupBy("path", "block").agg(F.sum("size").alias("out"))
    inner = blocks.join(F.broadcast(out), ["path", "block"], "left").withColumn("rest", F.col("bytes") - F.coalesce("out", F.lit(0)))
    by_file = inner.groupBy("path").agg(F.sum("rest").alias("rest")).join(files.select("path", "shard", "number"), "path")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = by_file.select("path", "shard", F.coalesce(F.sum("rest").over(before("shard", "number")), F.lit(0)).alias("base")).join(F.broadcast(borders), "shard")
    inner = inner.withColumn("within", F.coalesce(F.sum("rest").over(before("path", "block")), F.lit(0)))
    inner = inner.join(starts, "path").withColumn("start", F.col("base") + F.col("within"))
    cut = F.col("out").isNotNull() | F.exists("ends", lambda e: (e > F.col("start")) & (e < F.col("start") + F.col("rest")))
    inner = staged(inner.withColumn("cut", cut), "dealt")
    target = lambda at: F.get("targets", F.least(F.size(F.filter("ends", lambda e: e <= at)), F.size("targets") - 1))
    whole = inner.where("NOT cut").select("path", "shard", (F.col("block") * block).alias("at"), target(F.col("start")).alias("target"))

    # rows of the blocks that are cut, one by one: a document goes where its middle lies
    single = rows.join(inner.where("cut").select("path", "block", "shard", "start", "ends", "targets"), ["path", "block"])
    single = single.join(F.broadcast(taken.select("path", "at", F.col("target").alias("own"))), ["path", "at"], "left")
    kept = F.when(F.col("own").isNull(), F.col("size")).otherwise(0)
    single = single.withColumn("from", F.col("start") + F.coalesce(F.sum(kept).over(Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    single = single.select("path", "shard", "at", F.coalesce("own", target(F.col("from") + F.floor(F.col("size") / 2))).alias("target"))

    pieces = whole.unionByName(single)
    changes = pieces.withColumn("last", F.lag("target").over(Window.partitionBy("path").orderBy("at"))).where("last IS NULL OR last <> target")
    runs = changes.groupBy("path", "shard").agg(F.array_sort(F.collect_list(F.struct("at", "target"))).alias("runs"))
    return staged(runs, "runs"), sent


def resharded(docs: DataFrame, manifest: DataFrame, folder: str, shards: int = SHARDS, text_col: str = "text", block: int = BLOCK_ROWS) -> DataFrame:
    """Rewrite the files that lose documents; the new manifest (path, shard, first, rows, moved), first being its first slot in the shard.

    docs: a table read from the Parquet files of the manifest (path, shard,
    number), of any columns and names. Sizes of new shards are as equal as the
    documents at the ends of flows allow (a 1 / LONG of a shard each at most,
    unless one document exceeds a shard). Equal texts go where their places are.
    A null or empty text has size 1, repeated rows are rows of their own, ids
    aren't looked at. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    runs, _ = plan(docs, manifest, shards, text_col, block)
    staying = (F.size("runs") == 1) & (F.element_at("runs", 1)["target"] == F.col("shard"))
    moved = [r[0] for r in runs.where(~staying).select("path").collect()]  # names of files
    rows = runs.where(staying).select("path", "shard", F.lit(False).alias("moved"))
    if moved:
        name = "shard"
        while name in map(str.lower, docs.columns):
            name += "_"
        part = looked_up(_read(docs, moved), runs.select("path", "runs"), "path", "at", MANIFEST_ROWS)
        to = F.element_at(F.filter("runs", lambda r: r["at"] <= F.col("at")), -1)["target"]
        target = f"{folder}/{uuid.uuid4().hex}"
        part.select("row", to.alias("to")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("to").alias(name)).write.partitionBy(name).parquet(target)
        new = spark.read.schema(docs.schema).option("recursiveFileLookup", "true").parquet(target)
        new = new.select(F.col("_metadata.file_path").alias("path")).distinct()
        rows = rows.unionByName(new.select("path", F.regexp_extract("path", f"/{name}=(\\d+)/", 1).cast("int").alias("shard"), F.lit(True).alias("moved")))
    listed = staged(rows, "listed")
    counts = _read(docs, _paths(listed)).groupBy("path").agg(F.count("*").alias("rows"))
    listed = listed.join(counts, "path")
    first = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("moved", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return staged(listed.select("path", "shard", first.alias("first"), "rows", "moved"), "manifest")


def _paths(listed: DataFrame) -> list[str]:
    return [r[0] for r in listed.select("path").collect()]  # names of files


def _read(docs: DataFrame, paths: list[str]) -> DataFrame:
    """(row, path, at): the rows of the files, with their places."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if not paths:
        return docs.limit(0).select(row, F.lit("").alias("path"), F.lit(0).cast("long").alias("at"))
    found = docs.sparkSession.read.schema(docs.schema).parquet(*map(unquote, paths))  # the column of paths has them quoted
    return found.select(row, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))


def read_back(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(row, shard, slot, moved): the rows of the new shards' files; slots run from 0 in each shard without gaps."""
    found = looked_up(_read(docs, _paths(manifest)), manifest, "path", "at", MANIFEST_ROWS)
    return found.select("row", "shard", (F.col("first") + F.col("at")).alias("slot"), "moved")


def op13_resharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: the files of documents, file k in old shard k mod 16, resharded to 16 shards of equal bytes, and all files read back."""
    docs = table(spark, sf_dir, "documents")
    manifest = resharded(docs, files_of(docs, SHARDS), f"{own_dir(spark)}/shards")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    none = F.lit(None).cast("int")
    return read_back(docs, manifest).select(F.col("row.doc_id").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", none.alias("grown_shard"), "moved")
