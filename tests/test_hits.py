import pytest
from pyspark.sql import functions as F

from locusweave.functions.hits import genome_position, hit_distance, hit_score, hits_overlap, of
from locusweave.functions.stats import quantile, upper_tail
from locusweave.operators import hits

FIELDS = "qseqid string, sseqid string, qstart long, qend long, sstart long, send long, row_idx long"


def test_score_of_a_hit(spark):
    rows = [(1, 50, 3, 52, 1e-10, 60, 64), (1, 50, 3, 52, 1.0, 60, 64), (1, 50, 3, 52, 7.5, 60, 64)]
    df = spark.createDataFrame(rows, "qstart long, qend long, sstart long, send long, evalue double, qlen long, slen long")
    assert [r.K for r in df.select(hit_score().alias("K")).collect()] == [pytest.approx((1 - 1e-10) * 98 / 124), 0.0, 0.0]


@pytest.mark.parametrize(("strand", "observed", "want"), [("+", True, (1003, 1150)), ("-", True, (550, 403)), ("-", False, (1150, 1297)), ("+", False, (1003, 1150))])
def test_genome_position(spark, strand, observed, want):
    at = genome_position(F.lit(1), F.lit(50), F.lit(1000), F.lit(1300), F.lit(strand), observed)
    assert tuple(spark.range(1).select(*at).first()) == want


def test_distances(spark):
    rows = [(0, 100, 200, 50, 150), (1, 250, 300, 160, 260), (2, 1000, 1100, 900, 990)]
    df = spark.createDataFrame(rows, "row_idx long, g1start long, g1end long, g2start long, g2end long")
    a, b = hits.renamed(df, "i_"), hits.renamed(df, "j_")
    met = a.join(b, F.col("i_row_idx") < F.col("j_row_idx")).select("i_row_idx", "j_row_idx", hit_distance(of("i_"), of("j_")))
    assert {tuple(r) for r in met.collect()} == {(0, 1, 60), (1, 2, 1340), (0, 2, 1550)}


def overlap(i, j, both, crossed):
    """The rule, one pair at a time."""
    touch = lambda s, t, e, f: max(s, t) <= min(e, f)
    if i[:2] == j[:2]:
        axes = touch(i[2], j[2], i[3], j[3]), touch(i[4], j[4], i[5], j[5])
    elif i[0] == j[1] or i[1] == j[0]:
        axes = (touch(i[2], j[2], i[5], j[5]), touch(i[4], j[4], i[3], j[3])) if crossed else (touch(i[2], j[4], i[3], j[5]), touch(i[4], j[2], i[5], j[3]))
    else:
        return False
    return all(axes) if both else any(axes)


def test_overlap_and_reciprocal_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    make = lambda n, q, s: [(rng.choice(q), rng.choice(s), *(x for _ in range(2) for x in sorted((rng.randint(1, 30), rng.randint(1, 30)))), k) for k in range(n)]
    ba, ab = make(60, "ab", "xy"), make(60, "xy", "ab")
    one, two = spark.createDataFrame(ba, FIELDS), spark.createDataFrame(ab, FIELDS)
    for both in (True, False):
        for crossed in (True, False):
            got = sorted(map(tuple, hits.reciprocal(one, two, both, crossed).collect()))
            assert got == sorted(i for i in ba if any(i[0] == j[1] and i[1] == j[0] and overlap(i, j, both, crossed) for j in ab))
            pairs = hits.renamed(one, "i_").join(hits.renamed(one.union(two), "j_")).select(hits_overlap(of("i_"), of("j_"), both, crossed).alias("met"))
            assert sum(r.met for r in pairs.collect()) == sum(overlap(i, j, both, crossed) for i in ba for j in ba + ab)
    shared = lambda a, b, c, d: max(0, min(b, d) - max(a, c)) > 5
    met = {(i[6], j[6]) for i in ba for j in ba if i[6] < j[6] and (i[0] == j[0] and shared(*i[2:4], *j[2:4]) or i[1] == j[1] and shared(*i[4:6], *j[4:6]))}
    assert {tuple(r) for r in hits.any_overlap(one).collect()} == met
    groups = dict(hits.overlap_groups(one.withColumn("g", F.col("row_idx") % 12), "g").collect())
    assert groups == {g: any((i, j) in met for i in range(g, 60, 12) for j in range(i + 12, 60, 12)) for g in range(12)}


def test_unknown_exon_raises(spark):
    exons = spark.createDataFrame([("a", "p", "genome_1", "c", 1, 90, "+")], "exonid string, proteinid string, genome string, seqid string, start long, end long, strand string")
    rows = spark.createDataFrame([("a", "nope", 1, 5, 1, 5, 0)], FIELDS)
    with pytest.raises(Exception, match="unknown exon nope"):
        hits.genomic(rows, exons).collect()


def test_file_order(spark):
    ab = spark.createDataFrame([("x", "b", 1, 9, 1, 9, 0), ("x", "a", 1, 9, 1, 9, 1), ("x", "b", 1, 9, 1, 9, 2)], FIELDS)
    ba = spark.createDataFrame([("a", "x", 1, 9, 1, 9, 0), ("b", "x", 1, 9, 1, 9, 1), ("a", "x", 2, 8, 2, 8, 2)], FIELDS)
    rows = hits.in_file_order(hits.reciprocal(ba, ab), ab).orderBy("pair_idx", "row_idx").collect()
    assert [r.row_idx for r in rows] == [1, 0, 2]


def test_normal(spark):
    df = spark.createDataFrame([(0.0,), (1.96,), (float("inf"),), (float("nan"),), (9.5,)], "z double")
    got = [r[0] for r in df.select(upper_tail("z")).collect()]
    assert got[:3] == [0.5, pytest.approx(0.0249979, rel=1e-4), 0.0] and (got[3] is None or got[3] != got[3]) and got[4] == 0.0
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (0.975,)], "p double")
    assert [r[0] for r in df.select(quantile("p")).collect()] == [float("-inf"), pytest.approx(0, abs=1e-12), float("inf"), pytest.approx(1.959964)]


def test_surrogate_hits_get_their_exons_after_they_are_found_reciprocal(spark):
    from locusweave.plans import surrogate

    where = "/root/testdata/sf0.001"
    for observed in (True, False):
        got = surrogate.mutual(spark, where, observed)
        found = hits.reciprocal(surrogate.hits_ba(spark, where), surrogate.hits_ab(spark, where), crossed=observed)
        want = hits.genomic(hits.scored(found), surrogate.exons(spark, where), observed)
        assert got.columns == want.columns and got.count()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
