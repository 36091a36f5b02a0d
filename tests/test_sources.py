import gzip
import json
import random

import pytest

from locusweave import cli, config
from locusweave.operators import sequence, tracks
from locusweave.sources import readers, writers

FASTA = "lost line\n>a first one\nACGT\nAC GT  \n\n>b\nTTTT\n>a again\nGG\n>empty\n"
GFF = "##gff-version 3\nc1\tsrc\tCDS\t10\t20\t.\t+\t0\tID=x;Parent=p=q; Note=a%20b;flag\nc1\tshort\nc2\tsrc\tmRNA\t5\t9\t.\t-\t.\tID=m;\n"


@pytest.mark.parametrize("packed", [False, True])
def test_fasta(spark, tmp_path, packed):
    path = tmp_path / ("x.fa.gz" if packed else "x.fa")
    path.write_bytes(gzip.compress(FASTA.encode()) if packed else FASTA.encode())
    assert dict(readers.fasta(spark, str(path)).collect()) == {"a": "GG", "b": "TTTT", "empty": ""}


def test_fasta_with_other_line_ends_and_tabs(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b">a one\r\nACGT\r\n\tAC \t\r\n>b\r\n\r\nGG\r\n")
    assert dict(readers.fasta(spark, str(tmp_path / "x.fa")).collect()) == {"a": "ACGTAC", "b": "GG"}


def test_order_over_several_files(spark, tmp_path):
    """Files are read in order of their names, however large they are; the last of equal ids counts."""
    (tmp_path / "in").mkdir()
    for k, lines in enumerate((2, 3000, 1, 400)):
        (tmp_path / "in" / f"part-{k}.fa").write_text("".join(f">r{k}_{i}\nA\n" for i in range(lines)) + f">same\n{'ACGT'[k]}\n")
        (tmp_path / "in" / f"part-{k}.tsv").write_text("".join(f"{k}_{i}\tx\n" for i in range(lines)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert dict(readers.fasta(spark, str(tmp_path / "in" / "*.fa")).collect())["same"] == "T"
        rows = readers.table(spark, str(tmp_path / "in" / "*.tsv"), "key string, value string").orderBy("row_idx").collect()
        assert [r.key for r in rows] == [f"{k}_{i}" for k, n in enumerate((2, 3000, 1, 400)) for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gff3_with_quotes(spark, tmp_path):
    (tmp_path / "q.gff").write_bytes(b'"c 1"\tsrc\tmRNA\t1\t2\t.\t+\t.\t"ID=a""b;Note=x\ty"\r\nc2\ts"x\tmRNA\t1\t2\t.\t+\t.\tID=p"q\r\n')
    a, b = readers.gff3(spark, str(tmp_path / "q.gff")).orderBy("row_idx").collect()
    assert (a.seqid, a.attr) == ("c 1", {"ID": 'a"b', "Note": "x\ty"})
    assert (b.source, b.attr) == ('s"x', {"ID": 'p"q'})


def test_manifest_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "x", 1), ("a", "y", 2), ("a", "y", 3)], "g1chr string, g2chr string, n long")
    writers.write_pairs(pairs, str(tmp_path / "hits"))
    writers.write_manifest(writers.pair_manifest(pairs, str(tmp_path / "hits"), "trees"), str(tmp_path / "pairs"))
    rows = sorted(readers.pair_manifest(spark, str(tmp_path / "pairs")).collect())
    assert [(r.chrA, r.chrB, r.dendrogramfile) for r in rows] == [("a", "y", "trees/g1chr=a/g2chr=y"), ("b", "x", "trees/g1chr=b/g2chr=x")]
    assert [spark.read.parquet(r.hitsfile).count() for r in rows] == [2, 1]


def test_fasta_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("x", "A" * 80), ("y", "C" * 161), ("z", "")], "id string, seq string")
    assert "\n" + "A" * 80 + "\n" not in writers.fasta_text(rows).first().value + "x"
    writers.write_fasta(rows, str(tmp_path / "out"))
    assert sorted(readers.fasta(spark, str(tmp_path / "out")).collect()) == sorted(rows.collect())


def test_gff3(spark, tmp_path):
    (tmp_path / "x.gff").write_text(GFF)
    a, b = readers.gff3(spark, str(tmp_path / "x.gff")).orderBy("row_idx").collect()
    assert (a.seqid, a.start, a.end, a.attr) == ("c1", 10, 20, {"ID": "x", "Parent": "p", "Note": "a%20b", "flag": None})
    assert b.attr == {"ID": "m", "": None} and b.type == "mRNA"
    a = readers.gff3(spark, str(tmp_path / "x.gff"), decode=True).orderBy("row_idx").first()
    assert a.attr["Parent"] == "p=q" and a.attr["Note"] == "a b"


def test_tables(spark, tmp_path):
    (tmp_path / "hits.tsv").write_text("q\ts\t99.5\t10\t0\t0\t1\t10\t2\t11\t1e-5\t40\t30\t31\n" * 2)
    rows = readers.hits(spark, str(tmp_path / "hits.tsv")).orderBy("row_idx").collect()
    assert len(rows) == 2 and (rows[0].evalue, rows[0].slen, rows[0].qlen) == (1e-5, 30, 31)
    (tmp_path / "exons.tsv").write_text("#exonID\tx\n\ne\tp\tgenome_1\tc\t1\t9\t+\n#again\ne\tp2\tgenome_1\tc\t1\t9\t+\n")
    assert [r.proteinid for r in readers.exon_info(spark, str(tmp_path / "exons.tsv")).collect()] == ["p2"]
    (tmp_path / "map.tsv").write_text("a\tb\n")
    assert [tuple(r) for r in readers.mapping(spark, str(tmp_path / "map.tsv")).collect()] == [("a", "b")]
    (tmp_path / "bad.tsv").write_text("q\ts\tx\t10\t0\t0\t1\t10\t2\t11\t1e-5\t40\t30\t31\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.hits(spark, str(tmp_path / "bad.tsv")).collect()


def test_tree_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, -1, -1, [0]), (1, -1, -1, [1]), (2, 0, 1, [0, 1])], "node_id long, child1 long, child2 long, leaves array<long>")
    writers.write_tree(rows.coalesce(1), str(tmp_path / "tree"))
    assert sorted(map(str, readers.tree(spark, str(tmp_path / "tree")).collect())) == sorted(map(str, rows.collect()))


def test_cluster_text_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", -1, 1, 2, 3, 4, 1.5, 0.25, ["y", "x"], ["z"])], "chrA string, chrB string, clusterID long, startA long, endA long, startB long, endB long, score double, pvalue double, genesA array<string>, genesB array<string>")
    text = writers.cluster_text(rows)
    assert text.first().value == "a\tb\t-1\t1\t2\t3\t4\t1.500000\t0.250000\tx,y\tz"
    text.write.text(str(tmp_path / "c"))
    assert readers.clusters(spark, str(tmp_path / "c")).first().clusterID == "-1"


def test_tracks(spark):
    contigs = spark.createDataFrame([("c", 5), ("a", 7), ("b", 9)], "id string, length long")
    assert sorted(r.value for r in tracks.karyotype(contigs, "n").collect())[1] == "chr\t-\tn_b\tn_b\t0\t9\thsv(240,1,1)"
    clusters = spark.createDataFrame([("a", "b", 3, 1, 2, 3, 4)], "chrA string, chrB string, clusterID long, startA long, endA long, startB long, endB long")
    lines = [r.value for r in tracks.link_track(clusters, ("n", "m")).collect()]
    assert lines == ["c_0000000000\tn_a\t1\t2\tr_int=255,g_int=0,b_int=0", "c_0000000000\tm_b\t3\t4\tr_int=255,g_int=0,b_int=0"]
    text = tracks.plot_configuration(["n_a", "m_b"], ["k1", "k2"], "genes.tsv", "links.tsv")
    assert "chromosomes = n_a;m_b" in text and "file = links.tsv" in text and text.count("<links>") == text.count("</links>") == 1
    assert tracks.svg({"n_a": 10, "m_b": 20}, [("n_a", 1, 2, "m_b", 3, 4)]).count("<path") == 3


def test_contigs_in_pieces(spark, tmp_path):
    """Contigs that cover many splits, odd lines, several files and gzip: pieces put together are the whole records."""
    rng = random.Random(4)
    bases = lambda n: "".join(rng.choices("ACGTN", k=n))
    wrapped = lambda x, w, end: end.join(x[i : i + w] for i in range(0, len(x), w))
    (tmp_path / "in").mkdir()
    first = f"lost line\n>one note\n{wrapped(bases(40_000), 60, chr(10))}\n\n>two\r\n{wrapped(bases(7001), 80, chr(13) + chr(10))}\r\n>none\n>same\nAC\n"
    (tmp_path / "in" / "a.fa").write_bytes(first.encode())
    (tmp_path / "in" / "b.fa").write_text(f"no record\n>same\n {bases(500)} \n>three\n{bases(9000)}")
    (tmp_path / "in" / "c.fa.gz").write_bytes(gzip.compress(f">four\n{wrapped(bases(3000), 70, chr(10))}\n".encode()))
    path, setting = str(tmp_path / "in"), "spark.sql.files.maxPartitionBytes"
    whole = dict(readers.fasta(spark, path).collect())
    assert {k: len(v) for k, v in whole.items()} == {"one": 40_000, "two": 7001, "none": 0, "same": 500, "three": 9000, "four": 3000}
    before = spark.conf.get(setting)
    spark.conf.set(setting, "3000")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        assert dict(readers.fasta_lengths(spark, path).collect()) == {k: len(v) for k, v in whole.items()}
        for width in (1000, 1 << 16):
            found = {}
            for r in readers.fasta_pieces(spark, path, width).orderBy("id", "piece").collect():
                assert r.piece == len(found.setdefault(r.id, [])) and 0 < len(r.bases) <= width
                found[r.id].append(r.bases)
            assert {k: "".join(v) for k, v in found.items()} == {k: v for k, v in whole.items() if v}
            assert all(len(x) == width for v in found.values() for x in v[:-1])
    finally:
        spark.conf.set(setting, before)
    features = spark.createDataFrame([("one", "CDS", a, a + 299, "+-"[a % 2], {"Parent": f"p{a}"}, a) for a in range(1, 39_000, 777)], "seqid string, type string, start long, end long, strand string, attr map<string,string>, row_idx long")
    by = lambda genome, **k: sorted(map(tuple, sequence.proteins(genome, features, **k).collect()))
    assert by(readers.fasta_pieces(spark, path, 1000), width=1000) == by(readers.fasta(spark, path)) != []
    (tmp_path / "empty.fa").write_text("")
    assert readers.fasta_pieces(spark, str(tmp_path / "empty.fa")).count() == 0


def test_a_plot_for_each_chromosome(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "g1chr string, g2chr string")
    texts = {r.chr: r.value for r in tracks.configurations(pairs, ("n", "m"), ["k1", "k2"], "genes", "links").collect()}
    assert texts == {c: tracks.plot_configuration([f"n_{c}", "m_x", "m_y"], ["k1", "k2"], "genes", "links") for c in "ab"}
    sides = (spark.createDataFrame([("a", 2_000_000), ("b", 500), ("c", 9)], "id string, length long"), spark.createDataFrame([("x", 10), ("y", 0), ("z", 7)], "id string, length long"))
    clusters = spark.createDataFrame([("a", "x", 1000 * k, 1000 * k + 900, 3, 5) for k in range(3)] + [("a", "x", 1001, 1899, 3, 5), ("b", "x", 4, 90, 1, 2)], "chrA string, chrB string, startA long, endA long, startB long, endB long")
    drawn = {r.chr: r.value for r in tracks.pictures(clusters, pairs, sides, ("n", "m")).collect()}
    assert {c: (v.count('fill="red"'), v.count("<text")) for c, v in drawn.items()} == {"a": (3, 3), "b": (1, 2)}


def test_trees_of_an_analysis_are_read_back(spark, tmp_path):
    """Written in parts, a folder for each pair, and read again as the leaves below every node."""
    from .test_tree import genome, nodes_of

    exons, rows = genome(random.Random(3), 40)
    nodes = nodes_of(spark, exons, rows, tile=7)[3].cache()
    writers.write_trees(nodes, f"file://{tmp_path}/trees")
    manifest = writers.pair_manifest(nodes, "h", f"file://{tmp_path}/trees").collect()
    table = [r.asDict() for r in nodes.collect()]
    assert len(manifest) > 2
    for r in manifest:
        own = [n for n in table if (n["g1chr"], n["g2chr"]) == (r.chrA, r.chrB)]
        at = {n["leaf_lo"]: n["node_id"] for n in own if n["child1"] < 0}
        want = [(n["node_id"], n["child1"], n["child2"], sorted(at[x] for x in range(n["leaf_lo"], n["leaf_hi"]))) for n in own]
        assert sorted(map(tuple, readers.tree(spark, r.dendrogramfile).collect())) == sorted(want)


GOOD = {"genomes": {f"genome_{k}": {"name": f"n{k}", "genome": f"g{k}", "gff": f"a{k}"} for k in (1, 2)}}


@pytest.mark.parametrize(
    ("change", "match"),
    [
        ("{", "JSON"),
        ("{}", "no genomes"),
        (json.dumps({"genomes": {"genome_1": GOOD["genomes"]["genome_1"]}}), "must be"),
        (json.dumps({"genomes": GOOD["genomes"] | {"genome_2": {"name": "x"}}}), "exactly"),
        (json.dumps({"genomes": GOOD["genomes"] | {"genome_2": GOOD["genomes"]["genome_1"]}}), "differ"),
    ],
)
def test_bad_configurations(change, match):
    with pytest.raises(config.ValidationError, match=match):
        config.parse(change)


def test_configuration_defaults():
    got = config.parse(json.dumps(GOOD | {"p": 0.01, "extra": 1}))
    assert (got.p, got.cons_thresh, got.outdir, got.other) == (0.01, 1.0, "./", {"extra": 1})


def test_files_are_validated(spark, tmp_path):
    (tmp_path / "g").write_text(">c1\nA\n>c3\nA\n")
    (tmp_path / "a").write_text(GFF)
    raw = {"genomes": {"genome_1": {"name": "x", "genome": str(tmp_path / "g"), "gff": str(tmp_path / "a")}, "genome_2": {"name": "y", "genome": str(tmp_path / "no"), "gff": str(tmp_path / "a")}}}
    with pytest.raises(config.ValidationError) as e:
        config.validate(spark, config.parse(json.dumps(raw)))
    assert len(e.value.errors) == 3
    with pytest.raises(config.ValidationError):
        config.load(str(tmp_path / "none"))


def test_command_line(spark, tmp_path, capsys):
    """Two small genomes with one gene order, from files to tracks."""
    rng = random.Random(5)
    genes = ["ATG" + "".join(rng.choices("ACGT", k=120)).replace("TAA", "TCA").replace("TAG", "TCG").replace("TGA", "TCA") + "TAA" for _ in range(6)]
    raw = {"outdir": str(tmp_path / "out"), "cons_thresh": 0.1, "genomes": {}}
    for k in (1, 2):
        seq, gff, at = "", "", 1
        for i, gene in enumerate(genes):
            seq += "N" * 50 + gene
            at = len(seq) - len(gene) + 1
            gff += f"c{k}\tx\tCDS\t{at}\t{at + len(gene) - 1}\t.\t+\t0\tParent=p{k}_{i}\n"
        (tmp_path / f"g{k}").write_text(f">c{k} note\n{seq}\n")
        (tmp_path / f"a{k}").write_text(gff)
        raw["genomes"][f"genome_{k}"] = {"name": f"n{k}", "genome": str(tmp_path / f"g{k}"), "gff": str(tmp_path / f"a{k}")}
    path = tmp_path / "config.json"
    path.write_text(json.dumps(raw))
    assert cli.main([str(path), "-v"]) == 0
    assert cli.main([str(path), "-a", "plot"]) == 0
    assert "<svg" in spark.read.text(str(tmp_path / "out" / "plot.svg")).first().value
    assert any("n1_c1;n2_c2" in r.value for r in spark.read.text(str(tmp_path / "out" / "plot.conf")).collect())
    links = [r.value for r in spark.read.text(str(tmp_path / "out" / "links")).collect()]
    assert len(links) >= 2 and links[0].startswith("c_0000000000\tn1_c1")
    assert spark.read.text(str(tmp_path / "out" / "genes")).count() == 12
    raw["outdir"] = str(tmp_path / "hits_out")
    path.write_text(json.dumps(raw))
    assert cli.main([str(path), "-a", "hits"]) == 0
    manifest = readers.pair_manifest(spark, str(tmp_path / "hits_out" / "pairs")).collect()
    assert len(manifest) == 1 and readers.tree(spark, manifest[0].dendrogramfile).count() > 1
    assert cli.main([str(tmp_path / "none.json")]) == 1 and "doesn't exist" in capsys.readouterr().err
