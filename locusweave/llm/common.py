"""Tables, shared storage and Arrow slicing used by every operator here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.storage import written

#: Bytes of text that one numpy pass works on; longer texts are passes of their own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch that Python gets, at most; texts can be long.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> str | None:
    """Set batches for Python to BATCH_ROWS rows at most; the setting that was changed, if any.

    Queries and stages do this for their session, as their results are computed
    after they return; operators set nothing but for their own writing.
    """
    before = spark.conf.get(_BATCH)
    if 0 < int(before) <= BATCH_ROWS:
        return None
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    return before


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs the re-reading of a file, not
    the work before it. Batches for Python are small while it writes.
    """
    spark = df.sparkSession
    before = small_batches(spark)
    try:
        return written(df, name, **options)
    finally:
        if before is not None:
            spark.conf.set(_BATCH, before)


_kept: dict = {}


def kept(name: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks under a name; it keeps one thing at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) whose sizes add up to at most `most`, one row at least."""
    i, ends = 0, np.cumsum(sizes)
    while i < len(sizes):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right"))
        j = max(j, i + 1)
        yield i, j
        i = j


def byte_lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; nulls have none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and row offsets for slices of a batch's text column. What the worker kept for another operator goes."""
    _kept.clear()
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    for i, j in slices(np.diff(offsets)):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df plus `name`: each row's place, from 0, in the order of the columns `by`.

    Rows are dealt to partitions by range; only one count a partition reaches the
    driver. Rows equal in `by` are numbered in any order.
    """
    dealt = staged(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = {r[0]: r[1] for r in dealt.groupBy("_range").count().collect()}
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _before long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + within - 1).drop("_range", "_before")


#: Rows up to which a table of a few numbers and keys is broadcast.
BROADCAST_ROWS = 50_000


def looked_up(df: DataFrame, known: DataFrame, key: str, spread: str, most: int = BROADCAST_ROWS, salts: int = 64, share: int = 256) -> DataFrame:
    """Left join with a table of one row a key (null matches null), safe for hot keys.

    known is counted first: up to `most` rows it is broadcast. Beyond that, keys
    with more than one of `share` of df's rows are hot (fewer than `share` are):
    their rows in known are repeated for `salts` salts, and df's are spread over
    them by a hash of the column `spread`; other keys are joined plainly.
    """
    other = known.withColumnRenamed(key, "_key")
    if known.limit(most + 1).count() <= most:
        return df.join(F.broadcast(other), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    counts = staged(df.groupBy(F.col(key).alias("_hot")).count(), "counts")
    least = (counts.agg(F.sum("count")).first()[0] or 0) / share
    hot = counts.where(F.col("count") > least).select("_hot", F.lit(True).alias("_is"))
    own = F.when(F.col("_is"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    dealt = df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left").withColumn("_own", own).drop("_hot", "_is")
    all_ = F.when(F.col("_is"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    other = other.join(F.broadcast(hot), F.col("_key").eqNullSafe(F.col("_hot")), "left").withColumn("_salt", F.explode(all_)).drop("_hot", "_is")
    return dealt.join(other, (F.col("_own") == F.col("_salt")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key", "_own", "_salt")


def kept_rows(docs: DataFrame, out: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 100_000) -> DataFrame:
    """The rows of docs but for those of `out` (id, key), key being the hash of a row's text.

    What goes is counted first: up to `most` ids are broadcast, more are joined by
    a shuffle on the id. Rows with a null id stay.
    """
    out = out.select(F.col("id").alias("_id"), F.col("key").alias("_key")).where("_id IS NOT NULL").distinct()
    few = out.limit(most + 1).count() <= most
    same = (F.col(id_col).cast("long") == F.col("_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_key"))
    return docs.join(F.broadcast(out) if few else out, same, "left_anti")
