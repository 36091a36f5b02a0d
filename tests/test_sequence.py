import random

from pyspark.sql import functions as F

from locusweave.operators import intervals, sequence
from locusweave.plans.queries import GENOME

FEATURES = "seqid string, type string, start long, end long, strand string, attr map<string,string>, row_idx long"
SEGMENTS = "protein string, seqid string, start long, end long, strand string, row_idx long"


def test_translation(spark):
    genome = spark.createDataFrame([("c", GENOME)], "id string, seq string")
    rows = [("plus", 1, 18, "+"), ("minus", 27, 44, "-"), ("two", 1, 6, "+"), ("two", 10, 15, "+")]
    features = spark.createDataFrame([("c", "CDS", s, e, st, {"Parent": p}, k) for k, (p, s, e, st) in enumerate(rows)] + [("c", "mRNA", 1, 9, "+", {"ID": "plus"}, 9)], FEATURES)
    assert dict(sequence.proteins(genome, features).collect()) == {"plus": "MAKFG.", "minus": "MKFGPK", "two": "MAFG"}


def test_clean_up(spark):
    rows = [("a x", "MK."), ("b", "M.K"), ("c", "M-K"), ("d", ".MK"), ("e", "-MK"), ("f", "M"), ("g", ""), ("h", "MK..")]
    got = dict(sequence.clean_proteins(spark.createDataFrame(rows, "id string, seq string")).collect())
    assert got == {"a": "MK", "e": "-MK", "f": "M"}


def cut(spark, proteins, segments, observed):
    return sequence.exon_residues(spark.createDataFrame(proteins, "id string, seq string"), spark.createDataFrame(segments, SEGMENTS), "genome_1", observed).orderBy("number").collect()


def test_observed_residues(spark):
    rows = cut(spark, [("a", "ABCDEFGHIJ"), ("b", "KLMNOPQRST")], [("a", "c", 100, 112, "+", 0), ("a", "c", 200, 210, "+", 1), ("b", "c", 300, 306, "-", 2), ("b", "c", 400, 413, "-", 3)], True)
    assert [(r.exonid, r.seq) for r in rows] == [("G.genome_1.E.0", "ABCD"), ("G.genome_1.E.1", "EFG"), ("G.genome_1.E.2", "TSRQ"), ("G.genome_1.E.3", "PO")]


def test_intended_residues_are_whole(spark):
    rows = cut(spark, [("a", "ABCDEFG"), ("b", "KLMNOPQ")], [("a", "c", 100, 109, "+", 0), ("a", "c", 200, 210, "+", 1), ("b", "c", 300, 309, "-", 2), ("b", "c", 400, 410, "-", 3)], False)
    assert [r.seq for r in rows] == ["ABCD", "EFG", "KLMN", "OPQ"]


def test_top_level_parents(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "nowhere")]
    features = spark.createDataFrame([({"ID": i} | ({"Parent": p} if p else {}),) for i, p in rows], "attr map<string,string>")
    assert dict(sequence.top_level(features).collect()) == {"a": "a", "b": "a", "c": "a", "d": "a"}


def test_intervals(spark):
    regions = spark.createDataFrame([("r", "s", 100, 200), ("wide", "s", 0, 100_000), ("none", "s", 5, 5)], "region string, k string, lo long, hi long")
    features = spark.createDataFrame([("a", "s", 200, 250), ("b", "s", 50, 100), ("c", "s", 199, 210), ("d", "t", 150, 160)], "name string, k string, start long, end long")
    got = {(r.region, r.name) for r in intervals.overlapping(regions, features, ["k"], width=64).collect()}
    assert got == {("r", "c"), ("wide", "a"), ("wide", "b"), ("wide", "c")}
    assert {tuple(r) for r in intervals.depth(features, "k").collect()} == {("s", 50, 100, 1), ("s", 199, 200, 1), ("s", 200, 210, 2), ("s", 210, 250, 1), ("t", 150, 160, 1)}
    assert dict(intervals.covered(features, "k").collect()) == {"s": 101, "t": 10}


def ranges(rng, n, longest):
    """Ranges of two keys, some of no length, some wide."""
    return [(k, rng.choice("st"), (lo := rng.randrange(400)), lo + rng.choice([0, 1, 3, rng.randrange(longest)])) for k in range(n)]


def test_wide_and_narrow_regions_meet_all_that_overlaps(spark):
    """Bins of one position, so that most regions are wide."""
    rng = random.Random(3)
    regions, features = ranges(rng, 150, 900), ranges(rng, 150, 30)
    a, b = spark.createDataFrame(regions, "region long, k string, lo long, hi long"), spark.createDataFrame(features, "name long, k string, start long, end long")
    for points in (False, True):
        want = sorted((r, n) for r, k, lo, hi in regions for n, key, start, end in features if k == key and start < hi and end > lo and (points or (lo < hi and start < end)))
        assert sorted((r.region, r.name) for r in intervals.overlapping(a, b, ["k"], width=1, points=points).collect()) == want


def test_a_region_over_very_many_bins_meets_few_features(spark):
    regions = spark.createDataFrame([("r", "s", 0, 1 << 46)], "region string, k string, lo long, hi long")
    features = spark.createDataFrame([("a", "s", 5, 9), ("b", "s", 1 << 45, (1 << 45) + 1), ("c", "s", 1 << 46, (1 << 46) + 1)], "name string, k string, start long, end long")
    assert sorted(r.name for r in intervals.overlapping(regions, features, ["k"], width=1 << 22).collect()) == ["a", "b"]


def test_sums_over_regions_are_those_of_what_overlaps(spark):
    rng = random.Random(4)
    regions, features = ranges(rng, 150, 300), ranges(rng, 300, 30)
    a, b = spark.createDataFrame(regions, "region long, k string, lo long, hi long"), spark.createDataFrame(features, "name long, k string, start long, end long")
    found = intervals.summed(a, b, ["k"], {"n": F.lit(1), "names": F.col("name")})
    want = {(r, k, lo, hi): [n for n, key, start, end in features if k == key and start < hi and end > lo] for r, k, lo, hi in regions}
    assert {tuple(r[:4]): r[4:] for r in found.collect()} == {r: (len(names), sum(names)) for r, names in want.items()}
    assert any(lo == hi and want[r, k, lo, hi] for r, k, lo, hi in regions)


def test_tandem(spark):
    genes = spark.createDataFrame([("a", "s", 0, 10, "+"), ("b", "s", 20, 30, "+"), ("c", "s", 40, 50, "-"), ("d", "t", 0, 9, "+")], "id string, seqid string, start long, end long, strand string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("c", "b")], "id1 string, id2 string")
    assert {tuple(r) for r in intervals.tandem(pairs, genes).collect()} == {("a", "b", True), ("a", "c", False), ("a", "d", False), ("c", "b", True)}
    assert {tuple(r) for r in intervals.same_strand(pairs, genes).collect()} == {("a", "b", True), ("a", "c", False), ("a", "d", True), ("c", "b", False)}


def test_genes_of_an_annotation(spark):
    rows = [("c", "mRNA", 5, 9, "+", {"ID": "a"}, 0), ("c", "MRNA", 6, 9, "-", {"ID": "a"}, 1), ("c", "CDS", 1, 2, "+", {"ID": "b"}, 2), ("d", "mrna", 1, 2, "+", {"Parent": "x"}, 3), ("d", "mrna", 3, 4, "+", {"ID": "e"}, 4)]
    df = spark.createDataFrame(rows, "seqid string, type string, start long, end long, strand string, attr map<string,string>, row_idx long")
    assert sorted(map(tuple, sequence.genes(df).collect())) == [("a", "c", 6, 9, "-"), ("e", "d", 3, 4, "+")]
