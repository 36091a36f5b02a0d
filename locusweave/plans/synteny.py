"""From two annotated genomes, or from alignments, to significant clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.config import Config
from locusweave.operators import alignment, hits, sequence, testing, tracks, tree
from locusweave.schemas import GENOME_1, GENOME_2
from locusweave.sources import readers
from locusweave.storage import written


@dataclass(frozen=True)
class Analysis:
    """Tables of an analysis, in order; hits, nodes and tests are written where executors share a folder."""

    exons: DataFrame
    hits: DataFrame
    leaves: DataFrame
    nodes: DataFrame
    tests: DataFrame
    clusters: DataFrame


def exons_of(spark: SparkSession, config: Config, observed: bool = True) -> DataFrame:
    """Exons of both genomes with their residues, from their sequence and annotation files.

    Proteins without coding segments raise in observed mode and are skipped otherwise.
    """
    out = None
    for key in (GENOME_1, GENOME_2):
        genome = config.genomes[key]
        annotation = readers.gff3(spark, genome.gff)
        segments = sequence.coding(annotation, by_comma=not observed)
        proteins = sequence.clean_proteins(sequence.proteins(readers.fasta_pieces(spark, genome.genome), annotation))
        if observed and not sequence.without_segments(proteins, segments).isEmpty():
            raise ValueError(f"{key} has proteins without coding segments")
        rows = sequence.exon_residues(proteins, segments, key, observed)
        out = rows if out is None else out.unionByName(rows)
    return out


def clusters(exons: DataFrame, ab: DataFrame, ba: DataFrame, alpha: float = 0.05, threshold: float = 1.0, observed: bool = True) -> Analysis:
    """Significant clusters from exons and both directions of alignments; ba has the queries of genome 1."""
    info = exons.select("exonid", "proteinid", "genome", "seqid", "start", "end", "strand")
    mutual = hits.in_file_order(hits.reciprocal(ba, ab, both=True, crossed=observed), ab)
    placed = written(hits.genomic(hits.scored(mutual), info, observed), "hits")
    leaves = written(tree.numbered_leaves(placed, observed), "leaves")
    best = written(hits.best_hits(placed, "K"), "best")
    nodes = written(tree.scored_nodes(leaves, info, best), "nodes")
    moments = hits.null_moments(placed, best, info)
    pools = None if observed else testing.null_pools(placed, best, info, GENOME_1)
    tested = written(testing.tested(nodes, moments, threshold, observed, pools, alpha), "tests")
    chosen = testing.significant(tested, alpha, observed)
    return Analysis(exons, placed, leaves, nodes, tested, tracks.cluster_table(chosen, tested, placed, info, observed))


def run(spark: SparkSession, config: Config, observed: bool = True, tables: tuple[str, str] | None = None) -> Analysis:
    """The whole analysis; tables: files of alignments (queries of genome 2, queries of genome 1) instead of aligning here."""
    exons = written(exons_of(spark, config, observed), "exons")
    if tables:
        ab, ba = (readers.hits(spark, path) for path in tables)
    else:
        one, two = (exons.where(F.col("genome") == g).select(F.col("exonid").alias("id"), "seq") for g in (GENOME_1, GENOME_2))
        order = lambda df: df.withColumn("row_idx", F.xxhash64("qseqid", "sseqid"))
        ab, ba = (written(order(alignment.aligned(a, b)), "alignments") for a, b in ((two, one), (one, two)))
    return clusters(exons, ab, ba, config.p, config.cons_thresh, observed)


def contigs(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """(id, length) of each genome's contigs."""
    return {key: readers.fasta_lengths(spark, genome.genome) for key, genome in config.genomes.items()}


def drawings(spark: SparkSession, config: Config, analysis: Analysis) -> dict[str, DataFrame]:
    """(chr, value) by name: a plot configuration over the tracks, and a plain picture, for each chromosome of genome 1 that has hits."""
    names = (config.genomes[GENOME_1].name, config.genomes[GENOME_2].name)
    of, pairs = contigs(spark, config), analysis.hits.select("g1chr", "g2chr").distinct()
    texts = tracks.configurations(pairs, names, [f"karyotype.{k}" for k in sorted(config.genomes)], "genes", "links")
    return {"plot.conf": texts, "plot.svg": tracks.pictures(analysis.clusters, pairs, (of[GENOME_1], of[GENOME_2]), names)}


def plots(spark: SparkSession, config: Config, analysis: Analysis) -> dict[str, DataFrame]:
    """Track texts by name."""
    names = {k: g.name for k, g in config.genomes.items()}
    out = {}
    for key, rows in contigs(spark, config).items():
        out[f"karyotype.{key}"] = tracks.karyotype(rows, config.genomes[key].name)
    out["genes"] = tracks.gene_track(analysis.exons, names)
    out["exons"] = tracks.exon_track(analysis.exons, names)
    out["links"] = tracks.link_track(analysis.clusters, (names[GENOME_1], names[GENOME_2]))
    return out
