"""Writers: FASTA, delimited tables, cluster tables, and hits split by chromosome pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.operators.tree import leaves_of


def wrapped(seq: Column, width: int = 80) -> Column:
    """A sequence with a line break after each `width` letters."""
    return F.regexp_replace(seq, rf"(.{{{width}}})(?=.)", "$1\n")


def fasta_text(sequences: DataFrame, width: int = 80, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """(value): one FASTA record a row."""
    return sequences.select(F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), wrapped(F.col(seq_col), width)).alias("value"))


def write_fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    fasta_text(sequences, width).write.text(path)


def write_table(rows: DataFrame, path: str, header: str | None = None) -> None:
    """Tab-separated rows; a header line begins with # and stands at the head of each part."""
    out = rows.drop("row_idx")
    if header is not None:
        first, *rest = out.columns
        out = out.toDF(f"#{first}", *rest)
    out.write.option("sep", "\t").option("header", header is not None).option("quote", "").option("comment", "\u0001").csv(path)


def write_tree(nodes: DataFrame, path: str) -> None:
    """child1, child2 and comma-joined leaves, in order of node ids."""
    rows = nodes.orderBy("node_id").select(F.col("child1").alias("#child1"), "child2", F.array_join("leaves", ",").alias("leaves"))
    rows.write.option("sep", "\t").option("header", True).option("quote", "").option("comment", "\u0001").csv(path)


def tree_text(nodes: DataFrame) -> DataFrame:
    """(g1chr, g2chr, node_id, value): the line of each node of scored trees, as `write_tree` has it; a heading line of each tree has node -1."""
    keys = ["g1chr", "g2chr", "node_id"]
    leaves = leaves_of(nodes, nodes).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("leaf")), ",").alias("leaves"))
    lines = nodes.join(leaves, keys).select(*keys, F.format_string("%d\t%d\t%s", "child1", "child2", "leaves").alias("value"))
    heads = nodes.where("root").select("g1chr", "g2chr", F.lit(-1).cast("long").alias("node_id"), F.lit("#child1\tchild2\tleaves").alias("value"))
    return heads.unionByName(lines)


def write_trees(nodes: DataFrame, path: str) -> None:
    """Scored trees, a folder for each chromosome pair; lines in order of nodes, in parts that follow each other."""
    order = ["g1chr", "g2chr", "node_id"]
    lines = tree_text(nodes).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("g1chr", "g2chr", "value").write.partitionBy("g1chr", "g2chr").text(path)


def write_pairs(genomic: DataFrame, path: str) -> None:
    """Genomic hits, a folder for each chromosome pair that has any."""
    genomic.write.partitionBy("g1chr", "g2chr").parquet(path)


def pair_manifest(genomic: DataFrame, hits: str, trees: str) -> DataFrame:
    """(chrA, chrB, hitsfile, dendrogramfile): where `write_pairs` puts each pair that has hits, and where its tree goes."""
    folder = F.concat(F.lit("/g1chr="), F.col("g1chr"), F.lit("/g2chr="), F.col("g2chr"))
    pairs = genomic.select("g1chr", "g2chr").distinct()
    return pairs.select(F.col("g1chr").alias("chrA"), F.col("g2chr").alias("chrB"), F.concat(F.lit(hits), folder).alias("hitsfile"), F.concat(F.lit(trees), folder).alias("dendrogramfile"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest as a delimited text, in order of names, as `readers.pair_manifest` reads it."""
    write_table(manifest.orderBy("chrA", "chrB"), path)


def cluster_text(clusters: DataFrame) -> DataFrame:
    """(value): the cluster table's lines; genes are sorted and joined by commas, scores have six digits."""
    genes = lambda c: F.array_join(F.array_sort(c), ",")
    fields = ["chrA", "chrB", "clusterID", "startA", "endA", "startB", "endB"]
    line = F.format_string("\t".join(["%s"] * 2 + ["%d"] * 5 + ["%f"] * 2 + ["%s"] * 2), *fields, "score", "pvalue", genes("genesA"), genes("genesB"))
    return clusters.select(line.alias("value"))
