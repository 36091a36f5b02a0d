"""Reciprocal hits, their scores and places, best hits and null moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.hits import genome_position, hit_score, hits_overlap, of, overlap_beyond
from locusweave.schemas import GENOME_1


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def reciprocal(ba: DataFrame, ab: DataFrame, both: bool = True, crossed: bool = True) -> DataFrame:
    """The hits of ba (queries of genome 1) that some hit of ab on the swapped exon pair overlaps; repeats stay.

    A semi-join on both exons with the overlap as residual condition, so a hit
    stops at its first match and nothing is multiplied.
    """
    i, j = of(""), of("j_")
    other = renamed(ab.select("qseqid", "sseqid", "qstart", "qend", "sstart", "send"), "j_")
    swapped = (i("qseqid") == j("sseqid")) & (i("sseqid") == j("qseqid"))
    return ba.join(other, swapped & hits_overlap(i, j, both, crossed), "left_semi")


def in_file_order(hits: DataFrame, ab: DataFrame) -> DataFrame:
    """Reciprocal hits plus `pair_idx`: with row_idx it orders them by exon pairs as first met in ab, then as in ba."""
    first = ab.groupBy(F.col("sseqid").alias("qseqid"), F.col("qseqid").alias("sseqid")).agg(F.min("row_idx").alias("pair_idx"))
    return hits.join(first, ["qseqid", "sseqid"])


def scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("K", hit_score())


def genomic(hits: DataFrame, exons: DataFrame, observed: bool = True) -> DataFrame:
    """hits plus chromosome and positions in both genomes.

    A hit whose exon is unknown raises when it is computed.
    """
    info = exons.select("exonid", "seqid", "start", "end", "strand")
    out = hits
    for genome, exon, start, end in (("g1", "qseqid", "qstart", "qend"), ("g2", "sseqid", "sstart", "send")):
        side = renamed(info, f"{genome}_")
        out = out.join(side, F.col(exon) == F.col(f"{genome}_exonid"), "left")
        at = genome_position(F.col(start), F.col(end), F.col(f"{genome}_start"), F.col(f"{genome}_end"), F.col(f"{genome}_strand"), observed)
        known = F.when(F.col(f"{genome}_exonid").isNull(), F.raise_error(F.concat(F.lit("unknown exon "), F.col(exon)))).otherwise(F.col(f"{genome}_seqid"))
        out = out.withColumns({f"{genome}chr": known, f"{genome}start": at[0], f"{genome}end": at[1]}).drop(*[f"{genome}_{c}" for c in info.columns])
    return out


def best_hits(hits: DataFrame, score: str = "bitscore") -> DataFrame:
    """(exonid, best): the highest score of each exon, as query or subject."""
    roles = hits.select(F.explode(F.array("qseqid", "sseqid")).alias("exonid"), F.col(score).alias("score"))
    return roles.groupBy("exonid").agg(F.max("score").alias("best"))


def null_moments(hits: DataFrame, best: DataFrame, exons: DataFrame) -> DataFrame:
    """One row of means and population variances: of all K, and of the best hits of each genome's exons."""
    of_hits = hits.agg(F.avg("K").alias("mean_a"), F.var_pop("K").alias("var_a"))
    split = best.join(exons.select("exonid", "genome"), "exonid")
    one = F.when(F.col("genome") == GENOME_1, F.col("best"))
    two = F.when(F.col("genome") != GENOME_1, F.col("best"))
    of_best = split.agg(F.avg(one).alias("mean_u1"), F.var_pop(one).alias("var_u1"), F.avg(two).alias("mean_u2"), F.var_pop(two).alias("var_u2"))
    return of_hits.join(F.broadcast(of_best))


def overlap_groups(hits: DataFrame, key: str, allowed: int = 5) -> DataFrame:
    """(key, overlaps): whether any two hits of a group overlap by more than allowed.

    Two hits can only overlap on an exon that they share, so pairs are met by
    exon and only neighbours in order of their starts need comparing: a hit that
    begins within the furthest reach so far by more than allowed overlaps.
    """
    sides = []
    for exon, start, end in (("qseqid", "qstart", "qend"), ("sseqid", "sstart", "send")):
        long = hits.select(key, F.col(exon).alias("exon"), F.col(start).alias("start"), F.col(end).alias("end")).where(F.col("end") - F.col("start") > allowed)
        before = Window.partitionBy(key, "exon").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
        reach = F.max("end").over(before)
        sides.append(long.select(key, (reach.isNotNull() & (F.least(reach, F.col("end")) - F.col("start") > allowed)).alias("met")))
    met = sides[0].unionByName(sides[1]).groupBy(key).agg(F.coalesce(F.bool_or("met"), F.lit(False)).alias("met"))
    return hits.select(key).distinct().join(met, key, "left").select(key, F.coalesce("met", F.lit(False)).alias("overlaps"))


def any_overlap(hits: DataFrame, allowed: int = 5) -> DataFrame:
    """Pairs (i, j) of row_idx whose hits overlap by the group rule; joined by the exon they share."""
    i, j = of("i_"), of("j_")
    a, b = renamed(hits, "i_"), renamed(hits, "j_")
    found = [a.join(b, (i(x) == j(x)) & (i("row_idx") < j("row_idx")) & overlap_beyond(i, j, allowed)).select(i("row_idx").alias("i"), j("row_idx").alias("j")) for x in ("qseqid", "sseqid")]
    return found[0].union(found[1]).distinct()


def chromosome_pairs(exons: DataFrame, genome_1: str = GENOME_1) -> DataFrame:
    """(chrA, chrB): every chromosome of the first genome with every one of the others."""
    names = exons.select("genome", "seqid").distinct()
    a = names.where(F.col("genome") == genome_1).select(F.col("seqid").alias("chrA"))
    b = names.where(F.col("genome") != genome_1).select(F.col("seqid").alias("chrB")).distinct()
    return a.crossJoin(b)


def pair_counts(genomic_hits: DataFrame) -> DataFrame:
    """(g1chr, g2chr, n) of the pairs that have hits."""
    return genomic_hits.groupBy("g1chr", "g2chr").agg(F.count("*").alias("n"))
