"""Exons and alignments derived from orders and lineitem by integer arithmetic, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.operators.hits import genomic, reciprocal, scored
from locusweave.schemas import GENOME_1, GENOME_2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exon an order; even keys are genome 1."""
    key = F.col("o_orderkey")
    genome = F.when(key % 2 == 0, GENOME_1).otherwise(GENOME_2)
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("G."), genome, F.lit(".E."), key.cast("string")).alias("exonid"),
        F.concat(F.lit("P"), (key % 2).cast("string"), F.lit("_"), F.floor(key / 6).cast("string")).alias("proteinid"),
        genome.alias("genome"),
        F.concat(F.lit("chr"), (F.floor(key / 500) % 4).cast("string")).alias("seqid"),
        (key * 100).alias("start"),
        (key * 100 + 31 + F.col("o_custkey") % 60).alias("end"),
        F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate pair of exons a line item: keys in both genomes and ranges of residues."""
    even = F.col("l_orderkey") - F.col("l_orderkey") % 2
    span = F.floor(F.col("l_quantity") / 5)
    far = 2 * ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 7500) + 1
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("ln"),
        even.alias("qk"),
        F.when(F.col("l_returnflag") == "A", even + 1).otherwise(far).alias("sk"),
        (1 + F.col("l_linenumber")).cast("long").alias("a1"),
        (1 + F.col("l_linenumber") + span).cast("long").alias("a2"),
        (1 + F.col("l_suppkey") % 5).cast("long").alias("b1"),
        (1 + F.col("l_suppkey") % 5 + span).cast("long").alias("b2"),
        (F.col("l_discount") * F.col("l_tax")).alias("evalue"),
        (F.col("l_quantity") * 2).alias("bitscore"),
    )


def directed(spark: SparkSession, sf_dir: str, forward: bool) -> DataFrame:
    """Alignments with queries of genome 1 (forward: even lines) or of genome 2; row_idx is a stand-in for their file order."""
    return _aligned(spark, sf_dir, _pairs(spark, sf_dir).where(F.col("ln") % 2 == (0 if forward else 1)), forward)


def _aligned(spark: SparkSession, sf_dir: str, pairs: DataFrame, forward: bool) -> DataFrame:
    """Alignments of candidate pairs whose exons exist."""
    info = exons(spark, sf_dir).select("exonid", F.floor((F.col("end") - F.col("start")) / 3).alias("len"), F.substring_index("exonid", ".", -1).cast("long").alias("key"))
    side = lambda x: info.select(F.col("exonid").alias(f"{x}seqid"), F.col("len").alias(f"{x}len"), F.col("key").alias(f"{x}key"))
    q, s = ("qk", "sk") if forward else ("sk", "qk")
    a, b = ("a", "b") if forward else ("b", "a")
    met = pairs.join(side("q"), F.col(q) == F.col("qkey")).join(side("s"), F.col(s) == F.col("skey"))
    order = F.xxhash64("qseqid", "sseqid", f"{a}1", f"{a}2", f"{b}1", f"{b}2", "evalue")
    zero = F.lit(0).cast("long")
    return met.select(
        "qseqid", "sseqid", F.lit(100.0).alias("pident"), (F.col(f"{a}2") - F.col(f"{a}1") + 1).alias("length"), zero.alias("mismatch"), zero.alias("gapopen"),
        F.col(f"{a}1").alias("qstart"), F.col(f"{a}2").alias("qend"), F.col(f"{b}1").alias("sstart"), F.col(f"{b}2").alias("send"),
        "evalue", "bitscore", "slen", "qlen", order.alias("row_idx"),
    )


def hits_ba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed(spark, sf_dir, True)


def hits_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed(spark, sf_dir, False)


def mutual(spark: SparkSession, sf_dir: str, observed: bool = True) -> DataFrame:
    """Reciprocal hits with score and genome positions.

    Whether a hit is reciprocal is told from keys and residues, so only those that are get their exons.
    """
    pairs = _pairs(spark, sf_dir)
    forward = {"qk": "qseqid", "sk": "sseqid", "a1": "qstart", "a2": "qend", "b1": "sstart", "b2": "send"}
    back = {"sk": "qseqid", "qk": "sseqid", "b1": "qstart", "b2": "qend", "a1": "sstart", "a2": "send"}
    ba = pairs.where(F.col("ln") % 2 == 0).drop("ln").withColumnsRenamed(forward)
    ab = pairs.where(F.col("ln") % 2 == 1).select(*[F.col(c).alias(x) for c, x in back.items()])
    found = reciprocal(ba, ab, both=True, crossed=observed).withColumnsRenamed({x: c for c, x in forward.items()})
    return genomic(scored(_aligned(spark, sf_dir, found, True)), exons(spark, sf_dir), observed)


EX = """
ex AS (
  SELECT concat('G.', CASE WHEN o_orderkey % 2 = 0 THEN 'genome_1' ELSE 'genome_2' END, '.E.', CAST(o_orderkey AS VARCHAR)) AS exonid,
    concat('P', CAST(o_orderkey % 2 AS VARCHAR), '_', CAST(CAST(floor(o_orderkey / 6) AS BIGINT) AS VARCHAR)) AS proteinid,
    CASE WHEN o_orderkey % 2 = 0 THEN 'genome_1' ELSE 'genome_2' END AS genome,
    concat('chr', CAST(CAST(floor(o_orderkey / 500) AS BIGINT) % 4 AS VARCHAR)) AS seqid,
    o_orderkey * 100 AS start_, o_orderkey * 100 + 31 + o_custkey % 60 AS end_,
    CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderkey AS okey
  FROM orders)"""
P = """
p AS (
  SELECT l_linenumber AS ln, l_orderkey - l_orderkey % 2 AS qk,
    CASE WHEN l_returnflag = 'A' THEN l_orderkey - l_orderkey % 2 + 1 ELSE 2 * ((l_partkey * 7 + l_suppkey) % 7500) + 1 END AS sk,
    1 + l_linenumber AS a1, 1 + l_linenumber + CAST(floor(l_quantity / 5) AS INT) AS a2,
    1 + CAST(l_suppkey % 5 AS INT) AS b1, 1 + CAST(l_suppkey % 5 AS INT) + CAST(floor(l_quantity / 5) AS INT) AS b2,
    l_discount * l_tax AS evalue, l_quantity * 2 AS bitscore
  FROM lineitem)"""


def _directed_sql(name: str, odd: int, q: str, s: str, a: str, b: str) -> str:
    return f"""
{name} AS (
  SELECT x.exonid AS qseqid, y.exonid AS sseqid, CAST(100 AS DOUBLE) AS pident, CAST({a}2 - {a}1 + 1 AS BIGINT) AS length, CAST(0 AS BIGINT) AS mismatch, CAST(0 AS BIGINT) AS gapopen,
    CAST({a}1 AS BIGINT) AS qstart, CAST({a}2 AS BIGINT) AS qend, CAST({b}1 AS BIGINT) AS sstart, CAST({b}2 AS BIGINT) AS send, evalue, bitscore,
    CAST(floor((y.end_ - y.start_) / 3) AS BIGINT) AS slen, CAST(floor((x.end_ - x.start_) / 3) AS BIGINT) AS qlen
  FROM p JOIN ex x ON x.okey = {q} JOIN ex y ON y.okey = {s} WHERE ln % 2 = {odd})"""


BA = _directed_sql("ba", 0, "qk", "sk", "a", "b")
AB = _directed_sql("ab", 1, "sk", "qk", "b", "a")


def reciprocal_sql(logic: str = "AND", crossed: bool = True) -> str:
    if crossed:
        rule = f"greatest(i.qstart, j.qstart) <= least(i.send, j.send) {logic} greatest(i.sstart, j.sstart) <= least(i.qend, j.qend)"
    else:
        rule = f"greatest(i.qstart, j.sstart) <= least(i.qend, j.send) {logic} greatest(i.sstart, j.qstart) <= least(i.send, j.qend)"
    return f"""
rec AS (SELECT * FROM ba i WHERE EXISTS (SELECT 1 FROM ab j WHERE i.qseqid = j.sseqid AND i.sseqid = j.qseqid AND ({rule})))"""


K = """
sc AS (SELECT *, (1 - least(1.0, evalue)) * ((send - sstart) + (qend - qstart)) / (slen + qlen) AS K FROM rec)"""


def genomic_sql(observed: bool = True) -> str:
    def at(x: str, start: str, end: str) -> tuple[str, str]:
        if observed:
            minus = f"{x}.end_ - (({x}.end_ - {x}.start_) - {end}) * 3", f"{x}.end_ - (({x}.end_ - {x}.start_) - {start}) * 3"
        else:
            minus = f"{x}.end_ - 3 * {end}", f"{x}.end_ - 3 * {start}"
        plus = f"{start} * 3 + {x}.start_", f"{end} * 3 + {x}.start_"
        return tuple(f"CASE WHEN {x}.strand = '+' THEN {p} ELSE {m} END" for p, m in zip(plus, minus, strict=True))

    (s1, e1), (s2, e2) = at("x", "qstart", "qend"), at("y", "sstart", "send")
    return f"""
gh AS (
  SELECT sc.*, x.seqid AS g1chr, {s1} AS g1start, {e1} AS g1end, y.seqid AS g2chr, {s2} AS g2start, {e2} AS g2end,
    x.proteinid AS gene1, y.proteinid AS gene2, CAST(floor(x.okey / 100) AS BIGINT) AS block
  FROM sc JOIN ex x ON x.exonid = qseqid JOIN ex y ON y.exonid = sseqid)"""


def sql(select: str, *more: str, observed: bool = True, logic: str = "AND") -> str:
    """A statement over exons, both directions, reciprocal, scored and genomic hits."""
    parts = [EX, P, BA, AB, reciprocal_sql(logic, observed), K, genomic_sql(observed), *more]
    return "WITH " + ",".join(parts) + "\n" + select
