"""Registered queries of the synteny operators over the surrogate tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.config import contig_mismatch
from locusweave.functions.hits import hit_distance, of
from locusweave.operators import alignment, hits, intervals, sequence, testing, tracks, tree
from locusweave.plans import surrogate as data
from locusweave.plans.surrogate import sql
from locusweave.schemas import GENOME_1
from locusweave.sources import readers, writers
from locusweave.storage import numbered, written

QUERIES = {}
ORACLE_SQL = {}
NAMES = {"genome_1": "one", "genome_2": "two"}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def six(column: str) -> F.Column:
    return F.round(column, 6).alias(column)


FIELDS = "qseqid, sseqid, pident, length, mismatch, gapopen, qstart, qend, sstart, send, evalue, bitscore, slen, qlen"
EXON = "exonid, proteinid, genome, seqid, start_ AS \"start\", end_ AS \"end\", strand"


@query(sql(f"SELECT {EXON} FROM ex"))
def exon_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.exons(spark, sf_dir)


@query(sql(f"SELECT {FIELDS} FROM ba"))
def hits_ba(spark, sf_dir):
    return data.hits_ba(spark, sf_dir).drop("row_idx")


@query(sql(f"SELECT {FIELDS} FROM ab"))
def hits_ab(spark, sf_dir):
    return data.hits_ab(spark, sf_dir).drop("row_idx")


@query(sql(f"SELECT {FIELDS} FROM rec"))
def reciprocal_hits(spark, sf_dir):
    return hits.reciprocal(data.hits_ba(spark, sf_dir), data.hits_ab(spark, sf_dir)).drop("row_idx")


@query(sql(f"SELECT {FIELDS} FROM rec", logic="OR"))
def reciprocal_hits_or(spark, sf_dir):
    return hits.reciprocal(data.hits_ba(spark, sf_dir), data.hits_ab(spark, sf_dir), both=False).drop("row_idx")


@query(sql(f"SELECT {FIELDS} FROM rec", observed=False))
def reciprocal_hits_intended(spark, sf_dir):
    return hits.reciprocal(data.hits_ba(spark, sf_dir), data.hits_ab(spark, sf_dir), crossed=False).drop("row_idx")


@query(sql("SELECT qseqid, sseqid, qstart, sstart, evalue, round(K, 6) AS K FROM sc"))
def hit_score_k(spark, sf_dir):
    found = hits.scored(hits.reciprocal(data.hits_ba(spark, sf_dir), data.hits_ab(spark, sf_dir)))
    return found.select("qseqid", "sseqid", "qstart", "sstart", "evalue", six("K"))


PLACES = "qseqid, sseqid, round(K, 6) AS K, g1chr, g1start, g1end, g2chr, g2start, g2end"


@query(sql(f"SELECT {PLACES} FROM gh"))
def genomic_hits(spark, sf_dir):
    return data.mutual(spark, sf_dir).select("qseqid", "sseqid", six("K"), "g1chr", "g1start", "g1end", "g2chr", "g2start", "g2end")


@query(sql(f"SELECT {PLACES} FROM gh", observed=False))
def genomic_hits_intended(spark, sf_dir):
    return data.mutual(spark, sf_dir, False).select("qseqid", "sseqid", six("K"), "g1chr", "g1start", "g1end", "g2chr", "g2start", "g2end")


@query(sql("SELECT qseqid, CAST(count(*) AS BIGINT) AS n, bool_or(hit) AS overlaps FROM (SELECT i.qseqid, EXISTS (SELECT 1 FROM bi j WHERE j.n <> i.n AND j.qseqid = i.qseqid AND (greatest(0, least(i.qend, j.qend) - greatest(i.qstart, j.qstart)) > 5 OR (i.sseqid = j.sseqid AND greatest(0, least(i.send, j.send) - greatest(i.sstart, j.sstart)) > 5))) AS hit FROM bi i) GROUP BY qseqid", "bi AS (SELECT *, row_number() OVER () AS n FROM ba)"))
def overlap_groups(spark, sf_dir):
    found = data.hits_ba(spark, sf_dir).withColumn("group", F.col("qseqid"))
    n = found.groupBy("group").agg(F.count("*").alias("n"))
    return hits.overlap_groups(found, "group").join(n, "group").withColumnRenamed("group", "qseqid")


@query(sql("SELECT a.seqid AS chrA, b.seqid AS chrB FROM (SELECT DISTINCT seqid FROM ex WHERE genome = 'genome_1') a CROSS JOIN (SELECT DISTINCT seqid FROM ex WHERE genome <> 'genome_1') b"))
def chromosome_pairs(spark, sf_dir):
    return hits.chromosome_pairs(data.exons(spark, sf_dir))


@query(sql("SELECT g1chr, g2chr, count(*) AS n FROM gh GROUP BY g1chr, g2chr"))
def pair_hit_counts(spark, sf_dir):
    return hits.pair_counts(data.mutual(spark, sf_dir))


DISTANCE = "greatest(0, greatest(i.g1start, j.g1start) - least(i.g1end, j.g1end)) + greatest(0, greatest(i.g2start, j.g2start) - least(i.g2end, j.g2end))"


@query(sql(f"SELECT i.block, i.g1chr, i.g2chr, min({DISTANCE}) AS least, max({DISTANCE}) AS most, CAST(sum({DISTANCE}) AS BIGINT) AS total, count(*) AS pairs FROM gi i JOIN gi j ON i.block = j.block AND i.g1chr = j.g1chr AND i.g2chr = j.g2chr AND i.n < j.n GROUP BY ALL", "gi AS (SELECT *, row_number() OVER (ORDER BY qseqid, sseqid, qstart, qend, sstart, send, evalue) AS n FROM gh)"))
def pair_distances(spark, sf_dir):
    """Distances of hits within runs of 100 exons."""
    # equal hits have equal row_idx, but are hits of their own
    rows = written(blocks(spark, sf_dir).select("block", "g1chr", "g2chr", F.monotonically_increasing_id().alias("n"), "g1start", "g1end", "g2start", "g2end"), "hits")
    i, j = hits.renamed(rows, "i_"), hits.renamed(rows, "j_")
    met = i.join(j, [F.col("i_block") == F.col("j_block"), F.col("i_g1chr") == F.col("j_g1chr"), F.col("i_g2chr") == F.col("j_g2chr"), F.col("i_n") < F.col("j_n")])
    d = met.select(F.col("i_block").alias("block"), F.col("i_g1chr").alias("g1chr"), F.col("i_g2chr").alias("g2chr"), hit_distance(of("i_"), of("j_")).alias("d"))
    return d.groupBy("block", "g1chr", "g2chr").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.sum("d").alias("total"), F.count("*").alias("pairs"))


BEST = "best AS (SELECT exonid, max(K) AS best FROM (SELECT qseqid AS exonid, K FROM gh UNION ALL SELECT sseqid, K FROM gh) GROUP BY exonid)"


@query(sql("SELECT exonid, round(best, 6) AS best FROM best", BEST))
def best_hit_per_exon(spark, sf_dir):
    return hits.best_hits(data.mutual(spark, sf_dir), "K").select("exonid", six("best"))


MOMENTS = """moments AS (SELECT * FROM (SELECT avg(K) AS mean_a, var_pop(K) AS var_a FROM gh) CROSS JOIN
  (SELECT avg(best) AS mean_u1, var_pop(best) AS var_u1 FROM best JOIN ex USING (exonid) WHERE genome = 'genome_1') CROSS JOIN
  (SELECT avg(best) AS mean_u2, var_pop(best) AS var_u2 FROM best JOIN ex USING (exonid) WHERE genome <> 'genome_1'))"""
MOMENT = ("mean_a", "var_a", "mean_u1", "var_u1", "mean_u2", "var_u2")


def moments(spark, sf_dir):
    placed = written(data.mutual(spark, sf_dir), "hits")
    return hits.null_moments(placed, hits.best_hits(placed, "K"), data.exons(spark, sf_dir))


@query(sql("SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in MOMENT) + " FROM moments", BEST, MOMENTS))
def null_moments(spark, sf_dir):
    return moments(spark, sf_dir).select(*[six(c) for c in MOMENT])


def blocks(spark, sf_dir):
    """Genomic hits of runs of 100 exons of genome 1: fixed groups that SQL can express in place of tree nodes."""
    key = F.substring_index("qseqid", ".", -1).cast("long")
    return data.mutual(spark, sf_dir).withColumn("block", F.floor(key / 100))


def held_blocks(spark, sf_dir):
    """The same, written, for queries of several parts."""
    return written(blocks(spark, sf_dir), "hits")


GROUP = ["block", "g1chr", "g2chr"]
REGION = "region AS (SELECT block, g1chr, g2chr, min(g1start) AS g1lo, max(g1end) AS g1hi, min(g2start) AS g2lo, max(g2end) AS g2hi, sum(K) AS sum_k FROM gh GROUP BY ALL)"


def regions(held, *more):
    return held.groupBy(*GROUP).agg(F.min("g1start").alias("g1lo"), F.max("g1end").alias("g1hi"), F.min("g2start").alias("g2lo"), F.max("g2end").alias("g2hi"), F.sum("K").alias("sum_k"), *more)


@query(sql("SELECT block, g1chr, g2chr, g1lo, g1hi, g2lo, g2hi, round(sum_k, 6) AS sum_k FROM region", REGION))
def block_regions(spark, sf_dir):
    return regions(blocks(spark, sf_dir)).withColumn("sum_k", F.round("sum_k", 6))


@query(sql("SELECT block, g1chr, g2chr, count(DISTINCT gene1) AS genes1, count(DISTINCT gene2) AS genes2 FROM gh GROUP BY ALL"))
def block_genes(spark, sf_dir):
    genes = data.exons(spark, sf_dir).select("exonid", "proteinid")
    side = lambda exon, name: genes.select(F.col("exonid").alias(exon), F.col("proteinid").alias(name))
    rows = blocks(spark, sf_dir).join(side("qseqid", "a"), "qseqid").join(side("sseqid", "b"), "sseqid")
    return rows.groupBy(*GROUP).agg(F.count_distinct("a").alias("genes1"), F.count_distinct("b").alias("genes2"))


INSIDE = """inside AS (
  SELECT block, g1chr, g2chr, 1 AS side, exonid FROM region JOIN ex ON genome = 'genome_1' AND seqid = g1chr AND start_ < greatest(g1lo, g1hi) AND end_ > least(g1lo, g1hi)
  UNION ALL
  SELECT block, g1chr, g2chr, 2, exonid FROM region JOIN ex ON genome = 'genome_2' AND seqid = g2chr AND start_ < greatest(g2lo, g2hi) AND end_ > least(g2lo, g2hi))"""
ACCOUNTED = "accounted AS (SELECT block, g1chr, g2chr, qseqid AS exonid FROM gh UNION SELECT block, g1chr, g2chr, sseqid FROM gh)"
LEFT = "unacc AS (SELECT i.* FROM inside i ANTI JOIN accounted USING (block, g1chr, g2chr, exonid))"


def areas(held):
    """Both regions of each block, and the exons of its hits (genome 1 has the queries)."""
    found = regions(held, F.collect_set("qseqid").alias("met1"), F.collect_set("sseqid").alias("met2"))
    side = lambda n: F.struct(F.lit(n).alias("side"), F.col(f"g{n}chr").alias("seqid"), F.least(f"g{n}lo", f"g{n}hi").alias("lo"), F.greatest(f"g{n}lo", f"g{n}hi").alias("hi"), F.col(f"met{n}").alias("met"))
    return found.select(*GROUP, F.explode(F.array(side(1), side(2))).alias("r")).select(*GROUP, "r.*")


def sided(exons):
    """exons plus the side of blocks that they lie on."""
    return exons.where("genome IS NOT NULL").withColumn("side", F.when(F.col("genome") == GENOME_1, 1).otherwise(2))


def inside(areas, exons):
    """Exons of either genome that overlap each block's regions; a region of no length (one hit of one residue) lies within an exon."""
    return intervals.overlapping(areas, sided(exons).select("exonid", "side", "seqid", "start", "end"), ["side", "seqid"], points=True)


def accounted(held):
    return held.select(*GROUP, F.explode(F.array("qseqid", "sseqid")).alias("exonid")).distinct()


def unaccounted(held, exons):
    """Exons inside that no hit of the block has: regions bring theirs along, as the rows may be too many to be dealt once more."""
    return inside(areas(held), exons).where(~F.array_contains("met", F.col("exonid"))).select(*GROUP, "side", "exonid")


@query(sql("SELECT block, g1chr, g2chr, side, exonid FROM inside", REGION, INSIDE))
def region_exons(spark, sf_dir):
    return inside(areas(held_blocks(spark, sf_dir)).drop("met"), data.exons(spark, sf_dir)).select(*GROUP, "side", "exonid")


@query(sql("SELECT block, g1chr, g2chr, side, exonid FROM unacc", REGION, INSIDE, ACCOUNTED, LEFT))
def unaccounted_exons(spark, sf_dir):
    return unaccounted(held_blocks(spark, sf_dir), data.exons(spark, sf_dir))


@query(sql("SELECT block, g1chr, g2chr, side, exonid FROM unacc SEMI JOIN best USING (exonid)", REGION, INSIDE, ACCOUNTED, LEFT, BEST))
def unaccounted_with_hit(spark, sf_dir):
    held = held_blocks(spark, sf_dir)
    return unaccounted(held, data.exons(spark, sf_dir).join(hits.best_hits(held, "K"), "exonid", "left_semi"))


SCORE = """counts AS (SELECT block, g1chr, g2chr, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS u1, sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS u2, count(best) AS hit, sum(coalesce(best, 0)) AS lost
  FROM unacc LEFT JOIN best USING (exonid) GROUP BY ALL),
na AS (SELECT block, g1chr, g2chr, count(*) AS n_a FROM accounted GROUP BY ALL),
score AS (SELECT block, g1chr, g2chr, n_a, CAST(coalesce(u1, 0) AS BIGINT) AS n_u1, CAST(coalesce(u2, 0) AS BIGINT) AS n_u2, 2 * sum_k - coalesce(lost, 0) AS score, n_a / (coalesce(hit, 0) + 1) AS conservation
  FROM region JOIN na USING (block, g1chr, g2chr) LEFT JOIN counts USING (block, g1chr, g2chr))"""


def scores(held, exons):
    """Of each block the exons of its hits, the others inside and its score; of these others only sums are made, as wide regions have too many to list."""
    valued = written(sided(exons).join(hits.best_hits(held, "K"), "exonid", "left").select("exonid", "side", "seqid", "start", "end", F.col("best").cast("decimal(38,18)").alias("best")), "exons")
    ranges, members = areas(held).drop("met"), accounted(held)
    worth = {"n": F.lit(1), "hit": F.col("best").isNotNull().cast("int"), "lost": F.coalesce("best", F.lit(0).cast("decimal(38,18)"))}
    within = intervals.summed(ranges, valued.drop("exonid"), ["side", "seqid"], worth)
    own = members.join(valued, "exonid").join(ranges, [*GROUP, "side", "seqid"]).where("start < hi AND end > lo AND start <= end")
    rows = within.select(*GROUP, "side", *worth).unionByName(own.select(*GROUP, "side", *[(-x).alias(c) for c, x in worth.items()]))
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(f"n_u{side}")
    lost = rows.groupBy(*GROUP).agg(of(1), of(2), F.sum("hit").alias("hit"), F.sum("lost").cast("double").alias("lost"))
    n_a = members.groupBy(*GROUP).agg(F.count("*").alias("n_a"))
    rows = regions(held).join(n_a, GROUP).join(lost, GROUP, "left").fillna({"n_u1": 0, "n_u2": 0, "hit": 0, "lost": 0.0})
    return rows.select(*GROUP, "n_a", "n_u1", "n_u2", (2 * F.col("sum_k") - F.col("lost")).alias("score"), (F.col("n_a") / (F.col("hit") + 1)).alias("conservation"))


SCORED = (REGION, INSIDE, ACCOUNTED, LEFT, BEST, SCORE)


@query(sql("SELECT block, g1chr, g2chr, n_a, n_u1, n_u2, round(score, 6) AS score FROM score", *SCORED))
def block_score(spark, sf_dir):
    return scores(held_blocks(spark, sf_dir), data.exons(spark, sf_dir)).select(*GROUP, "n_a", "n_u1", "n_u2", six("score"))


@query(sql("SELECT block, g1chr, g2chr, round(conservation, 6) AS conservation FROM score WHERE conservation >= 1", *SCORED))
def block_conservation(spark, sf_dir):
    return scores(held_blocks(spark, sf_dir), data.exons(spark, sf_dir)).where("conservation >= 1").select(*GROUP, six("conservation"))


@query(sql("SELECT block, g1chr, g2chr, round((score - (2 * mean_a * n_a - mean_u1 * n_u1 - mean_u2 * n_u2)) / sqrt(4 * var_a * n_a + var_u1 * n_u1 + var_u2 * n_u2), 6) AS z FROM score CROSS JOIN moments", *SCORED, MOMENTS))
def block_clt_z(spark, sf_dir):
    held, exons = held_blocks(spark, sf_dir), data.exons(spark, sf_dir)
    return testing.clt_z(scores(held, exons), hits.null_moments(held, hits.best_hits(held, "K"), exons)).select(*GROUP, six("z"))


def _leaves(spark, sf_dir, observed=True):
    placed = written(data.mutual(spark, sf_dir, observed), "hits")
    return placed, written(tree.numbered_leaves(placed, observed), "leaves")


def _tree(spark, sf_dir, observed=True):
    placed, leaves = _leaves(spark, sf_dir, observed)
    exons = data.exons(spark, sf_dir)
    best = written(hits.best_hits(placed, "K"), "best")
    return placed, exons, best, tree.scored_nodes(leaves, exons, best)


@query()
def linkage_heights(spark, sf_dir):
    """Merge heights of each chromosome pair's tree."""
    return tree.merge_heights(_leaves(spark, sf_dir)[1])


# a block's merges below a height are its hits less the parts that links of such distances leave
LINKAGE = "WITH RECURSIVE " + sql(
    "SELECT block, g1chr, g2chr, h AS height, n - parts AS merges FROM (SELECT block, g1chr, g2chr, h, count(*) AS n, count(DISTINCT m) AS parts FROM (SELECT block, g1chr, g2chr, h, a, min(b) AS m FROM reach GROUP BY ALL) GROUP BY ALL)",
    "gi AS (SELECT *, row_number() OVER (ORDER BY qseqid, sseqid, qstart, qend, sstart, send, evalue) AS n FROM gh)",
    "cut AS (SELECT CAST(unnest([100, 300, 1000]) AS BIGINT) AS h)",
    f"near AS (SELECT i.block, i.g1chr, i.g2chr, h, i.n AS a, j.n AS b FROM gi i JOIN gi j ON i.block = j.block AND i.g1chr = j.g1chr AND i.g2chr = j.g2chr JOIN cut ON {DISTANCE} <= h)",
    "reach AS (SELECT * FROM near UNION SELECT r.block, r.g1chr, r.g2chr, r.h, r.a, n.b FROM reach r JOIN near n ON r.block = n.block AND r.g1chr = n.g1chr AND r.g2chr = n.g2chr AND r.h = n.h AND r.b = n.a)",
).removeprefix("WITH ")


@query(LINKAGE)
def block_linkage(spark, sf_dir):
    """Merges below given heights in trees of all runs of 100 exons."""
    return merges_below(blocks(spark, sf_dir))


@query(LINKAGE)
def block_linkage_all(spark, sf_dir):
    """The same by its former name."""
    return block_linkage(spark, sf_dir)


def merges_below(placed: DataFrame) -> DataFrame:
    """(block, g1chr, g2chr, height, merges) of the genomic hits of blocks."""
    rows = placed.withColumn("g1chr", F.concat_ws("|", F.col("block").cast("string"), "g1chr"))
    leaves = tree.numbered_leaves(rows, observed=False)
    n = leaves.groupBy("g1chr", "g2chr").agg(F.lit(0).alias("extra"))
    edges = tree.linkage(leaves)
    cuts = n.withColumn("height", F.explode(F.array(*[F.lit(h).cast("long") for h in (100, 300, 1000)])))
    below = cuts.join(edges.withColumnRenamed("height", "d"), ["g1chr", "g2chr"], "left").groupBy("g1chr", "g2chr", "height").agg(F.count_if(F.col("d") <= F.col("height")).alias("merges"))
    part = F.split("g1chr", r"\|")
    return below.select(part[0].cast("long").alias("block"), part[1].alias("g1chr"), "g2chr", "height", "merges")


@query()
def tree_nodes(spark, sf_dir):
    return _tree(spark, sf_dir)[3]


def _tests(spark, sf_dir, observed=True, threshold=1.0):
    placed, exons, best, nodes = _tree(spark, sf_dir, observed)
    nodes = written(nodes, "nodes")
    pools = None if observed else testing.null_pools(placed, best, exons, GENOME_1)
    return placed, exons, written(testing.tested(nodes, hits.null_moments(placed, best, exons), threshold, observed, pools), "tests")


@query()
def node_tests(spark, sf_dir):
    return _tests(spark, sf_dir)[2].select("g1chr", "g2chr", "node_id", "eligible", "clt", "z", "p")


@query()
def perm_pvalues(spark, sf_dir):
    tests = _tests(spark, sf_dir, observed=False)[2]
    return tests.where("eligible AND NOT clt").select("n_a", "n_u1", "n_u2", "score", "p", "z").distinct()


@query()
def clusters(spark, sf_dir):
    """Significant clusters by the observed method."""
    placed, exons, tests = _tests(spark, sf_dir)
    return tracks.cluster_table(testing.significant(tests), tests, placed, exons)


@query()
def clusters_intended(spark, sf_dir):
    """Significant clusters by the documented method."""
    placed, exons, tests = _tests(spark, sf_dir, observed=False)
    return tracks.cluster_table(testing.significant(tests, observed=False), tests, placed, exons, observed=False)


@query(sql("SELECT concat(CASE WHEN genome = 'genome_1' THEN 'one' ELSE 'two' END, '_', seqid, chr(9), CAST(min(start_) AS VARCHAR), chr(9), CAST(max(end_) AS VARCHAR), chr(9), 'strand=', CASE WHEN arg_min(strand, exonid) = '+' THEN 'p' ELSE 'n' END, ',geneid=', proteinid) AS value FROM ex GROUP BY genome, seqid, proteinid"))
def gene_track(spark, sf_dir):
    return tracks.gene_track(data.exons(spark, sf_dir), NAMES)


@query(sql("SELECT concat(CASE WHEN genome = 'genome_1' THEN 'one' ELSE 'two' END, '_', seqid, chr(9), CAST(start_ AS VARCHAR), chr(9), CAST(end_ AS VARCHAR), chr(9), 'strand=', CASE WHEN strand = '+' THEN 'p' ELSE 'n' END, ',geneid=', proteinid, ',exonid=', exonid) AS value FROM ex"))
def exon_track(spark, sf_dir):
    return tracks.exon_track(data.exons(spark, sf_dir), NAMES)


@query(sql("SELECT concat('chr', chr(9), '-', chr(9), name, '_', seqid, chr(9), name, '_', seqid, chr(9), '0', chr(9), CAST(length AS VARCHAR), chr(9), 'hsv(', CAST(CAST(floor(360.0 * row_number() OVER (PARTITION BY name ORDER BY seqid) / count(*) OVER (PARTITION BY name)) AS BIGINT) AS VARCHAR), ',1,1)') AS value FROM (SELECT CASE WHEN genome = 'genome_1' THEN 'one' ELSE 'two' END AS name, seqid, max(end_) AS length FROM ex GROUP BY genome, seqid)"))
def karyotype(spark, sf_dir):
    """Contigs of both genomes."""
    exons = data.exons(spark, sf_dir)
    sides = [tracks.karyotype(exons.where(F.col("genome") == genome).groupBy(F.col("seqid").alias("id")).agg(F.max("end").alias("length")), name) for genome, name in NAMES.items()]
    return sides[0].unionByName(sides[1])


@query(sql("""SELECT concat('c_', lpad(CAST(n AS VARCHAR), 10, '0'), chr(9), id, chr(9), CAST(lo AS VARCHAR), chr(9), CAST(hi AS VARCHAR), chr(9), 'r_int=255,g_int=0,b_int=0') AS value
FROM (SELECT n, concat('one_', g1chr) AS id, g1lo AS lo, g1hi AS hi FROM link UNION ALL SELECT n, concat('two_', g2chr), g2lo, g2hi FROM link)""", REGION, "link AS (SELECT *, row_number() OVER (ORDER BY g1chr, g2chr, block) - 1 AS n FROM region)"))
def link_track(spark, sf_dir):
    rows = regions(blocks(spark, sf_dir)).select(F.col("g1chr").alias("chrA"), F.col("g2chr").alias("chrB"), F.col("block").alias("clusterID"), F.col("g1lo").alias("startA"), F.col("g1hi").alias("endA"), F.col("g2lo").alias("startB"), F.col("g2hi").alias("endB"))
    return tracks.link_track(rows, ("one", "two"))


RUNS = "runs AS (SELECT g1chr, least(g1start, g1end) AS s, greatest(g1start, g1end) AS e FROM gh), ev AS (SELECT g1chr, pos, sum(d) AS d FROM (SELECT g1chr, s AS pos, 1 AS d FROM runs WHERE s < e UNION ALL SELECT g1chr, e, -1 FROM runs WHERE s < e) GROUP BY ALL), dep AS (SELECT g1chr, pos AS \"start\", lead(pos) OVER w AS \"end\", CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY g1chr ORDER BY pos))"


def _runs(spark, sf_dir):
    return data.mutual(spark, sf_dir).select("g1chr", F.least("g1start", "g1end").alias("start"), F.greatest("g1start", "g1end").alias("end"))


@query(sql('SELECT g1chr, "start", "end", depth FROM dep WHERE depth > 0', RUNS))
def coverage_depth(spark, sf_dir):
    return intervals.depth(_runs(spark, sf_dir), "g1chr")


@query(sql('SELECT g1chr, CAST(sum("end" - "start") AS BIGINT) AS positions FROM dep WHERE depth > 0 GROUP BY g1chr', RUNS))
def covered_positions(spark, sf_dir):
    return intervals.covered(_runs(spark, sf_dir), "g1chr")


GENES = "gene AS (SELECT proteinid AS id, concat(genome, '|', min(seqid)) AS seqid, min(start_) AS s, max(end_) AS e, arg_min(strand, exonid) AS strand FROM ex GROUP BY genome, proteinid), two AS (SELECT a.id AS id1, b.id AS id2, a.seqid AS seq1, b.seqid AS seq2, least(a.e, b.e) AS lo, greatest(a.s, b.s) AS hi, a.strand AS st1, b.strand AS st2 FROM gene a JOIN gene b ON substr(a.id, 1, 3) = substr(b.id, 1, 3) AND CAST(substr(b.id, 4) AS BIGINT) - CAST(substr(a.id, 4) AS BIGINT) IN (1, 2))"


def _genes(spark, sf_dir):
    """Pairs of genes of one genome that are one or two apart in number, and all genes of both."""
    of = data.exons(spark, sf_dir).groupBy("genome", F.col("proteinid").alias("id"))
    rows = of.agg(F.concat_ws("|", "genome", F.min("seqid")).alias("seqid"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("strand", "exonid").alias("strand")).drop("genome")
    number, head = F.substr("id", F.lit(4)).cast("long"), F.substr("id", F.lit(1), F.lit(3)).alias("head")
    a = rows.select(F.col("id").alias("id1"), head, F.explode(F.array(number + 1, number + 2)).alias("n"))
    return a.join(rows.select(F.col("id").alias("id2"), head, number.alias("n")), ["head", "n"]).select("id1", "id2"), rows


@query(sql("SELECT id1, id2, seq1 = seq2 AND NOT EXISTS (SELECT 1 FROM gene g WHERE g.seqid = seq1 AND g.id <> id1 AND g.id <> id2 AND g.s < hi AND g.e > lo AND lo < hi) AS tandem FROM two", GENES))
def tandem_genes(spark, sf_dir):
    pairs, genes = _genes(spark, sf_dir)
    return intervals.tandem(pairs, genes)


@query(sql("SELECT id1, id2, st1 = st2 AS same FROM two", GENES))
def same_strand(spark, sf_dir):
    pairs, genes = _genes(spark, sf_dir)
    return intervals.same_strand(pairs, genes)


FEATURE = "concat('ID=f', CAST(o_orderkey AS {s}), CASE WHEN o_orderkey % 8 <> 0 THEN concat('; Parent=f', CAST(o_orderkey - 1 AS {s}), '=x') ELSE '' END, ';flag')"


def _features(spark, sf_dir):
    text = F.expr(FEATURE.format(s="STRING"))
    return data.table(spark, sf_dir, "orders").select("o_orderkey", readers.attributes(text).alias("attr"))


@query("SELECT o_orderkey, concat('f', o_orderkey) AS id, CASE WHEN o_orderkey % 8 <> 0 THEN concat('f', o_orderkey - 1) END AS parent, true AS flagged, CAST(NULL AS VARCHAR) AS flag FROM orders")
def attr_map(spark, sf_dir):
    attr = F.col("attr")
    return _features(spark, sf_dir).select("o_orderkey", attr["ID"].alias("id"), attr["Parent"].alias("parent"), F.map_contains_key(attr, "flag").alias("flagged"), attr["flag"].alias("flag"))


@query("WITH RECURSIVE up AS (SELECT o_orderkey AS k, o_orderkey AS r FROM orders UNION ALL SELECT k, r - 1 FROM up WHERE r % 8 <> 0), reach AS (SELECT k, min(r) AS r, count(*) AS n FROM up GROUP BY k) SELECT concat('f', k) AS id, concat('f', r) AS root FROM reach WHERE r % 8 = 0 AND r IN (SELECT o_orderkey FROM orders)")
def top_level_parent(spark, sf_dir):
    return sequence.top_level(_features(spark, sf_dir))


MRNA = """WITH g AS (SELECT concat('g', o_orderkey // 3) AS id, concat('c', o_custkey % 3) AS seqid, o_orderkey * 10 AS s, o_orderkey * 10 + 5 + o_custkey % 40 AS e,
  CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0),
gene AS (SELECT id, arg_max(seqid, k) AS seqid, arg_max(s, k) AS s, arg_max(e, k) AS e, arg_max(strand, k) AS strand FROM g GROUP BY id)"""


def _annotated_genes(spark, sf_dir):
    """Genes of annotation rows made of orders: messenger RNAs in any letter case, several of one id."""
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(key % 5 == 0, "CDS").when(key % 2 == 0, "mRNA").otherwise("MRNA")
    attr = readers.attributes(F.concat(F.lit("ID=g"), F.floor(key / 3).cast("string"), F.lit(";note")))
    rows = data.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (other % 3).cast("string")).alias("seqid"), kind.alias("type"), (key * 10).alias("start"), (key * 10 + 5 + other % 40).alias("end"), F.when(other % 2 == 0, "+").otherwise("-").alias("strand"), attr.alias("attr"), key.alias("row_idx"))
    return sequence.genes(rows)


@query(MRNA + ' SELECT id, seqid, s AS "start", e AS "end", strand FROM gene')
def annotated_genes(spark, sf_dir):
    return _annotated_genes(spark, sf_dir)


@query(MRNA + """, two AS (SELECT a.id AS id1, b.id AS id2, a.seqid AS seq1, b.seqid AS seq2, least(a.e, b.e) AS lo, greatest(a.s, b.s) AS hi, a.strand AS st1, b.strand AS st2 FROM gene a JOIN gene b ON CAST(substr(b.id, 2) AS BIGINT) - CAST(substr(a.id, 2) AS BIGINT) IN (1, 2, 3))
SELECT id1, id2, seq1 = seq2 AND NOT EXISTS (SELECT 1 FROM gene g WHERE g.seqid = seq1 AND g.id <> id1 AND g.id <> id2 AND g.s < hi AND g.e > lo AND lo < hi) AS tandem, st1 = st2 AS same FROM two""")
def annotated_tandems(spark, sf_dir):
    """Neighbouring genes of an annotation: whether they are tandem, and on one strand."""
    genes = written(_annotated_genes(spark, sf_dir), "genes")
    number = F.substr("id", F.lit(2)).cast("long")
    near = genes.select(F.col("id").alias("id1"), F.explode(F.array(number + 1, number + 2, number + 3)).alias("n"))
    pairs = near.join(genes.select(F.col("id").alias("id2"), number.alias("n")), "n").select("id1", "id2")
    return intervals.tandem(pairs, genes).join(intervals.same_strand(pairs, genes), ["id1", "id2"])


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS seq FROM documents)
SELECT concat('d', doc_id) AS id, CASE WHEN seq LIKE '%.' THEN left(seq, length(seq) - 1) ELSE seq END AS seq FROM w
WHERE regexp_full_match(CASE WHEN seq LIKE '%.' THEN left(seq, length(seq) - 1) ELSE seq END, '[^>.](?s:[^.-]*)')""")
def protein_clean(spark, sf_dir):
    words = data.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" note")).alias("id"), F.explode(F.split("text", " ")).alias("seq"))
    return sequence.clean_proteins(words)


@query(sql("""SELECT proteinid, exonid, taken, CAST(coalesce(sum(taken) OVER (PARTITION BY proteinid ORDER BY along ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT proteinid, exonid, CAST(floor((end_ - start_) / 3.0) AS BIGINT) AS taken, CASE WHEN first_value(strand) OVER (PARTITION BY proteinid ORDER BY start_) = '+' THEN start_ ELSE -start_ END AS along FROM ex)"""))
def residue_offsets(spark, sf_dir):
    """Where each exon's residues begin in its protein, from proteins that spell positions."""
    rows = data.exons(spark, sf_dir)
    segments = rows.select(F.col("proteinid").alias("protein"), "seqid", "start", "end", "strand", F.col("start").alias("row_idx"))
    alphabet = "".join(chr(0x4E00 + i) for i in range(400))
    proteins = rows.groupBy(F.col("proteinid").alias("id")).agg(F.lit(alphabet).alias("seq"))
    cut = sequence.exon_residues(proteins, segments, GENOME_1)
    minus = F.first("strand").over(Window.partitionBy("proteinid").orderBy("start")) != "+"
    start = F.instr(F.when(minus, F.reverse(F.lit(alphabet))).otherwise(F.lit(alphabet)), F.substr("seq", F.lit(1), F.lit(1))) - 1
    key = (F.col("start") / 100).cast("long")
    exonid = F.concat(F.lit("G."), F.when(key % 2 == 0, "genome_1").otherwise("genome_2"), F.lit(".E."), key.cast("string"))
    return cut.select("proteinid", exonid.alias("exonid"), F.length("seq").cast("long").alias("taken"), start.cast("long").alias("start"))


@query("SELECT concat('>', p_partkey, chr(10), array_to_string(list_transform(range(0, CAST(ceil(length(p_name) / 10.0) AS BIGINT)), lambda i: substr(p_name, i * 10 + 1, 10)), chr(10))) AS value FROM part")
def exon_fasta_lines(spark, sf_dir):
    rows = data.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("seq"))
    return writers.fasta_text(rows, 10)


# customers as contigs, and those of orders as the contigs that an annotation names
@query("SELECT CAST(coalesce(a, b) AS VARCHAR) AS contig, CASE WHEN b IS NULL THEN 'sequence' ELSE 'annotation' END AS side FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey + o_custkey % 7 AS b FROM orders) ON a = b WHERE a IS NULL OR b IS NULL")
def contigs_of_one_side(spark, sf_dir):
    sequence_ids = data.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    annotated = data.table(spark, sf_dir, "orders").select((F.col("o_custkey") + F.col("o_custkey") % 7).cast("string").alias("seqid"))
    return contig_mismatch(sequence_ids, annotated)


GENOME = "ATGGCCAAATTTGGGTAACCCATGCATTTAGGCCCAAATTTCATGG"


# contigs spelt from the names of parts; even ones are coded on the minus strand, in two segments
@query("""WITH c AS (SELECT p_partkey AS k, translate(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTNCGTACGTACGTAC') AS seq FROM part),
b AS (SELECT k, CASE WHEN k % 2 = 0 THEN translate(reverse(concat(substr(seq, 1, 6), substr(seq, 10, 6))), 'ACGT', 'TGCA') ELSE concat(substr(seq, 1, 6), substr(seq, 10, 6)) END AS bases FROM c)
SELECT concat('p', k) AS id, array_to_string(list_transform(range(0, length(bases) // 3), lambda i: CASE WHEN contains(substr(bases, 3 * i + 1, 3), 'N') THEN 'X' ELSE
  substr('FFLLSSSSYY..CC.WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(16 * (instr('TCAG', substr(bases, 3 * i + 1, 1)) - 1) + 4 * (instr('TCAG', substr(bases, 3 * i + 2, 1)) - 1) + instr('TCAG', substr(bases, 3 * i + 3, 1)) AS BIGINT), 1) END), '') AS seq FROM b""")
def part_translation(spark, sf_dir):
    """Proteins of all contigs of a table."""
    letters = F.regexp_replace(F.lower("p_name"), "[^a-z]", "")
    part = data.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTNCGTACGTACGTAC").alias("seq"))
    contig, parent = F.concat(F.lit("c"), F.col("k").cast("string")), F.concat(F.lit("p"), F.col("k").cast("string"))
    segments = F.array(F.struct(F.lit(10).alias("start"), F.lit(15).alias("end")), F.struct(F.lit(1).alias("start"), F.lit(6).alias("end")))
    rows = part.select(contig.alias("seqid"), F.lit("CDS").alias("type"), F.when(F.col("k") % 2 == 0, "-").otherwise("+").alias("strand"), F.create_map(F.lit("Parent"), parent).alias("attr"), F.posexplode(segments).alias("row_idx", "x"))
    features = rows.select("seqid", "type", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), "strand", "attr", F.col("row_idx").cast("long").alias("row_idx"))
    return sequence.proteins(part.select(contig.alias("id"), "seq"), features)


@query()
def table_alignment(spark, sf_dir):
    """All alignments of passages, read as peptides, with each other, up to an expectation value of 0.001."""
    letters = F.regexp_replace(F.upper("text"), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    spelt = data.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), letters.alias("seq"))
    return alignment.aligned(spelt, spelt, evalue=1e-3)


# places of hits within their pair, and ranges of 120 that begin every 50
RANGES = "gn AS (SELECT *, row_number() OVER (PARTITION BY g1chr, g2chr ORDER BY qseqid, sseqid, qstart, qend, sstart, send, evalue) - 1 AS n FROM gh), sp AS (SELECT g1chr, g2chr, unnest(range(0, max(n) + 1, 50)) AS lo FROM gn GROUP BY g1chr, g2chr)"


@query(sql("SELECT g1chr, g2chr, lo // 50 AS node_id, count(*) AS leaves, count(DISTINCT qseqid) AS exons, min(n) AS first, max(n) AS last FROM sp JOIN gn USING (g1chr, g2chr) WHERE n >= lo AND n < lo + 120 GROUP BY g1chr, g2chr, lo", RANGES))
def range_members(spark, sf_dir):
    """Members of overlapping ranges of all hits of each pair."""
    keys = ["g1chr", "g2chr"]
    placed = numbered(data.mutual(spark, sf_dir), [*keys, "qseqid", "sseqid", "qstart", "qend", "sstart", "send", "evalue"], "at")
    pairs = placed.groupBy(*keys).agg(F.min("at").alias("start"), F.count("*").alias("n"))
    leaves = placed.join(pairs, keys).withColumn("leaf", F.col("at") - F.col("start"))
    nodes = leaves.select(*keys, F.col("leaf").alias("node_id"), F.col("leaf").alias("leaf_lo"), "row_idx")
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(50).cast("long")))
    chosen = pairs.select(*keys, "n", lo.alias("leaf_lo")).withColumns({"node_id": F.floor(F.col("leaf_lo") / 50), "leaf_hi": F.least(F.col("leaf_lo") + 120, "n")})
    members = tree.leaves_of(nodes, chosen).join(leaves.select(*keys, "leaf", "qseqid"), [*keys, "leaf"])
    return members.groupBy(*keys, "node_id").agg(F.count("*").alias("leaves"), F.count_distinct("qseqid").alias("exons"), F.min("leaf").alias("first"), F.max("leaf").alias("last"))


@query(sql("SELECT qseqid, sseqid, qstart, sstart, g1chr, g2chr, tests FROM (SELECT *, count(*) OVER (PARTITION BY g1chr, g2chr) AS tests FROM gh) WHERE evalue * tests < 0.05"))
def significant_hits(spark, sf_dir):
    """Hits whose expectation value is significant after as many tests as their pair has hits."""
    rows, keys = data.mutual(spark, sf_dir), ["g1chr", "g2chr"]
    tests = rows.groupBy(*keys).agg(F.count("*").alias("tests"))
    return rows.join(tests, keys).where(testing.corrected(F.col("evalue"), F.col("tests"), 0.05)).select("qseqid", "sseqid", "qstart", "sstart", *keys, "tests")
