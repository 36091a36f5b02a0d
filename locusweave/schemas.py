"""Schemas of the tables that the operators exchange, as DDL. Positions and counts are long, scores double."""

from __future__ import annotations

HITS = (
    "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, qstart long, qend long, "
    "sstart long, send long, evalue double, bitscore double, slen long, qlen long"
)
SCORED = f"{HITS}, K double"
GENOMIC = f"{SCORED}, g1chr string, g1start long, g1end long, g2chr string, g2start long, g2end long"
EXONS = "exonid string, proteinid string, genome string, seqid string, start long, end long, strand string"
CLUSTERS = "chrA string, chrB string, clusterID string, startA long, endA long, startB long, endB long, score double, pvalue double, genesA string, genesB string"
PAIRS = "chrA string, chrB string, hitsfile string, dendrogramfile string"
MAPPING = "key string, value string"

#: The two genomes of an analysis, by their fixed keys.
GENOME_1, GENOME_2 = "genome_1", "genome_2"
#: Group of features without a parent.
TOP_LEVEL = "__TOPLEVEL__"
