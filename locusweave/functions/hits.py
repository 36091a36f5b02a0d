"""Column functions over alignment hits: overlap, distance, score and genome position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Hit = Callable[[str], Column]


def of(prefix: str) -> Hit:
    """Columns of a joined side by prefix."""
    return lambda name: F.col(f"{prefix}{name}")


def touching(start_a: Column, start_b: Column, end_a: Column, end_b: Column) -> Column:
    """Whether two closed ranges share a position."""
    return F.greatest(start_a, start_b) <= F.least(end_a, end_b)


def shared_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length that two half-open ranges share."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def hits_overlap(i: Hit, j: Hit, both: bool = False, crossed: bool = True) -> Column:
    """Whether two hits overlap on one of their axes, or on both.

    Hits of one direction are compared axis by axis. For hits of opposite
    directions `crossed` keeps the observed rule, which takes starts of one axis
    with ends of the other; otherwise i's query meets j's subject and vice versa.
    Hits of other sequences don't overlap.
    """
    joined = (lambda a, b: a & b) if both else (lambda a, b: a | b)
    same = joined(touching(i("qstart"), j("qstart"), i("qend"), j("qend")), touching(i("sstart"), j("sstart"), i("send"), j("send")))
    if crossed:
        other = joined(touching(i("qstart"), j("qstart"), i("send"), j("send")), touching(i("sstart"), j("sstart"), i("qend"), j("qend")))
    else:
        other = joined(touching(i("qstart"), j("sstart"), i("qend"), j("send")), touching(i("sstart"), j("qstart"), i("send"), j("qend")))
    along = (i("qseqid") == j("qseqid")) & (i("sseqid") == j("sseqid"))
    across = (i("qseqid") == j("sseqid")) | (i("sseqid") == j("qseqid"))
    return F.when(along, same).when(across, other).otherwise(F.lit(False))


def overlap_beyond(i: Hit, j: Hit, allowed: int = 5) -> Column:
    """Whether two hits of one query, or of one subject, share more than `allowed` positions of it."""
    query = (i("qseqid") == j("qseqid")) & (shared_length(i("qstart"), i("qend"), j("qstart"), j("qend")) > allowed)
    subject = (i("sseqid") == j("sseqid")) & (shared_length(i("sstart"), i("send"), j("sstart"), j("send")) > allowed)
    return query | subject


def hit_score() -> Column:
    """K: the aligned share of both exons, less the chance that it means nothing."""
    aligned = (F.col("send") - F.col("sstart")) + (F.col("qend") - F.col("qstart"))
    return (1 - F.least(F.lit(1.0), F.col("evalue"))) * aligned / (F.col("slen") + F.col("qlen"))


def genome_position(start: Column, end: Column, exon_start: Column, exon_end: Column, strand: Column, observed: bool = True) -> tuple[Column, Column]:
    """Chromosome positions of residues of an exon.

    On the minus strand the observed rule subtracts residues from the exon's
    length in bases, so start exceeds end; otherwise positions count back from
    the exon's end.
    """
    length = exon_end - exon_start
    back = (exon_end - (length - end) * 3, exon_end - (length - start) * 3) if observed else (exon_end - 3 * end, exon_end - 3 * start)
    plus = strand == "+"
    return F.when(plus, start * 3 + exon_start).otherwise(back[0]), F.when(plus, end * 3 + exon_start).otherwise(back[1])


def hit_distance(i: Hit, j: Hit) -> Column:
    """Bases between two hits, summed over both genomes; overlap counts as none."""
    gap = lambda g: F.greatest(F.lit(0), F.greatest(i(f"{g}start"), j(f"{g}start")) - F.least(i(f"{g}end"), j(f"{g}end")))
    return gap("g1") + gap("g2")
