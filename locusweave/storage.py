"""Written tables that cut a plan: what comes after reads a file instead of doing the work again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset a local session gets a temporary folder of its own; any
    other raises, as its executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as Parquet in the application's folder, read again; a lost executor costs the re-reading of a file.

    The files stay until `clear`, as results that are computed later read them.
    """
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many partitions as shuffles have, for groups of few bytes and much work: adaptive plans would put them all into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df plus `name`: each row's place, from 0, in the order of the columns `by`; ties in any order.

    Rows are dealt to partitions by range and counted there; one count a partition
    is added up, so no task holds all rows.
    """
    dealt = written(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_range", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + within - 1).drop("_range", "_before")


def running(df: DataFrame, keys: list[str], by: list[str], sums: dict[str, Column]) -> DataFrame:
    """df plus running sums, by name, of each key's rows in the order of `by`, the row's own value included.

    Rows are dealt to ranges of keys and order and added up there; a range's totals
    are carried on to the ranges after it, so a key's rows spread over tasks. Rows
    equal in keys and order stay in one range, and are added up in any order.
    """
    named = df.withColumns({f"_of_{c}": x for c, x in sums.items()})
    dealt = written(named.repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range", *keys).agg(*[F.sum(f"_of_{c}").alias(f"_all_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_range").alias("_in"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    within = Window.partitionBy("_range", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumns({f"_within_{c}": F.sum(f"_of_{c}").over(within) for c in sums})
    same = F.col("_range") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    found = found.join(before, same)
    return found.select(*df.columns, *[(F.col(f"_before_{c}") + F.col(f"_within_{c}")).alias(c) for c in sums])


def highest_before(df: DataFrame, keys: list[str], by: list[str], value: Column, name: str) -> DataFrame:
    """df plus `name`: the highest value of each key's rows before the row in the order of `by`, which has no ties; null if there is none.

    As in `running`, a range's highest value is carried on to the ranges after it.
    """
    dealt = written(df.withColumn("_value", value).repartitionByRange(*keys, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    tops = dealt.groupBy("_range", *keys).agg(F.max("_value").alias("_top"))
    before = F.max("_top").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = tops.select("_range", *keys, before.alias("_before"))
    within = F.max("_value").over(Window.partitionBy("_range", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    found = dealt.withColumn("_within", within).join(F.broadcast(carried), ["_range", *keys])
    return found.select(*df.columns, F.greatest("_before", "_within").alias(name))


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written; call it once no result is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
