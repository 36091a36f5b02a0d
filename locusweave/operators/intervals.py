"""Interval joins and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.storage import running


#: Regions of more bins are dealt to bins so many times as wide.
WIDE, WIDER = 64, 256


def overlapping(regions: DataFrame, features: DataFrame, keys: list[str], width: int = 1 << 14, points: bool = False) -> DataFrame:
    """Pairs of regions (lo, hi) and features (start, end) of equal keys that overlap, both half-open.

    Both sides are dealt to bins of `width` positions by their keys, so a crowded
    key is spread over its bins; a pair is kept in the first bin that both touch. Wide
    regions meet all features in wider bins, so that their rows don't outnumber these.
    Empty ranges overlap nothing or, with points, what begins before and ends after
    them. Other columns of both sides pass.
    """
    below = "<=" if points else "<"
    features, wide = features.where(f"start {below} end"), F.col("hi") - F.col("lo") > WIDE * width
    found = [_met(regions.where(f"lo {below} hi").where(some), features, keys, size) for some, size in ((~wide, width), (wide, width * WIDER))]
    return found[0].unionByName(found[1])


def _met(regions: DataFrame, features: DataFrame, keys: list[str], width: int) -> DataFrame:
    """`overlapping` in bins of one width."""
    first = lambda c: F.floor(F.col(c) / width).cast("long")
    last = lambda begin, c: F.floor((F.greatest(F.col(begin) + 1, c) - 1) / width).cast("long")
    a = regions.withColumn("bin", F.explode(F.sequence(first("lo"), last("lo", "hi"))))
    b = features.withColumn("bin", F.explode(F.sequence(first("start"), last("start", "end"))))
    met = a.join(b, [*keys, "bin"]).where("start < hi AND end > lo")
    return met.where(F.col("bin") == F.greatest(first("lo"), first("start"))).drop("bin")


def summed(regions: DataFrame, features: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """regions (lo, hi) plus sums by name over the features (start, end) of equal keys that overlap them, as `overlapping` with points has them.

    These are the features that begin before a region's end less those that end by
    its begin. Both are running sums, so the work is regions and features, whatever
    regions span. A feature of no length doesn't overlap a region of none.
    """
    event = lambda ends, at, late: F.struct(F.lit(ends).alias("_ends"), F.col(at).alias("_at"), late.alias("_late"))
    spread_out = lambda df, *events: df.withColumn("_e", F.explode(F.array(*events))).select(*df.columns, "_e.*")
    places = spread_out(features.where("start <= end"), event(False, "start", F.lit(1)), event(True, "end", F.when(F.col("start") == F.col("end"), 2).otherwise(0)))
    asked = spread_out(regions.where("lo <= hi"), event(False, "hi", F.lit(0)), event(True, "lo", F.when(F.col("lo") == F.col("hi"), 1).otherwise(3)))
    both = places.drop("start", "end").withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    upto = running(both, [*keys, "_ends"], ["_at", "_late"], {f"_up_{c}": F.when(~F.col("_asked"), x).otherwise(0) for c, x in sums.items()}).where("_asked")
    return upto.groupBy(*regions.columns).agg(*[F.sum(F.when(F.col("_ends"), -F.col(f"_up_{c}")).otherwise(F.col(f"_up_{c}"))).alias(c) for c in sums])


def depth(regions: DataFrame, key: str) -> DataFrame:
    """(key, start, end, depth): runs of equal coverage by half-open regions (start, end), where there is any.

    Steps are added up where they are before they are dealt, and running sums are
    carried from range to range, so a key's positions spread over tasks. The end of a
    run is the next step's place, which the last step of a range gets from the
    first one after it.
    """
    edges = regions.where("start < end").select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = edges.groupBy(key, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    runs = running(steps, [key], ["at"], {"depth": F.col("step"), "place": F.lit(1)}).drop("step")
    after = runs.select(F.col(key).alias("_key"), (F.col("place") - 1).alias("_place"), F.col("at").alias("end"))
    met = runs.where("depth > 0").join(after, F.col(key).eqNullSafe(F.col("_key")) & (F.col("place") == F.col("_place")))
    return met.select(key, F.col("at").alias("start"), "end", "depth")


def covered(regions: DataFrame, key: str) -> DataFrame:
    """(key, positions): how many positions some region covers."""
    return depth(regions, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("positions"))


def tandem(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """pairs (id1, id2) plus `tandem`: on one sequence, and no third gene overlaps the gap between them.

    genes: (id, seqid, start, end), ids without repeats.
    """
    side = lambda n: genes.select(F.col("id").alias(f"id{n}"), F.col("seqid").alias(f"seq{n}"), F.col("start").alias(f"start{n}"), F.col("end").alias(f"end{n}"))
    known = pairs.join(side(1), "id1").join(side(2), "id2")
    gaps = known.where("seq1 = seq2").select("id1", "id2", F.col("seq1").alias("seqid"), F.least("end1", "end2").alias("lo"), F.greatest("start1", "start2").alias("hi"))
    others = overlapping(gaps, genes.select(F.col("id").alias("between"), "seqid", "start", "end"), ["seqid"])
    broken = others.where("between != id1 AND between != id2").select("id1", "id2").distinct().withColumn("broken", F.lit(True))
    return known.join(broken, ["id1", "id2"], "left").select("id1", "id2", (F.col("seq1") == F.col("seq2")).alias("one"), "broken").select("id1", "id2", (F.col("one") & F.col("broken").isNull()).alias("tandem"))


def same_strand(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """pairs (id1, id2) plus `same`: whether both genes (id, strand) lie on one strand."""
    side = lambda n: genes.select(F.col("id").alias(f"id{n}"), F.col("strand").alias(f"strand{n}"))
    return pairs.join(side(1), "id1").join(side(2), "id2").select("id1", "id2", (F.col("strand1") == F.col("strand2")).alias("same"))
