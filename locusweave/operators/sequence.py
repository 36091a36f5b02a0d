"""From annotated genomes to residues of exons: translation, clean-up, slicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.schemas import TOP_LEVEL
from locusweave.storage import written

# The standard genetic code, bases in the order T, C, A, G.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES = "TCAG"


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def translated(seq: Column) -> Column:
    """Residues of a coding sequence; a stop is a dot, a codon with other letters X, leftover bases count for nothing."""
    upper = F.upper(seq)

    def residue(i: Column) -> Column:
        a, b, c = (_index(F.substr(upper, 3 * i + k, F.lit(1))) for k in (1, 2, 3))
        known = (a >= 0) & (b >= 0) & (c >= 0)
        letter = F.substr(F.lit(CODE.replace("*", ".")), (a * 16 + b * 4 + c + 1).cast("int"), F.lit(1))
        return F.when(known, letter).otherwise("X")

    codons = F.floor(F.length(seq) / 3).cast("int")
    all_ = F.when(codons > 0, F.transform(F.sequence(F.lit(0), codons - 1), residue)).otherwise(F.array().cast("array<string>"))
    return F.array_join(all_, "")


def _index(base: Column) -> Column:
    out = F.lit(-1)
    for k, letter in enumerate(BASES):
        out = F.when(base == letter, k).otherwise(out)
    return out


def parent(attr: Column) -> Column:
    """The group that a feature belongs to."""
    return F.coalesce(attr["Parent"], F.lit(TOP_LEVEL))


def genes(annotation: DataFrame) -> DataFrame:
    """(id, seqid, start, end, strand) of the messenger RNAs of an annotation, by their type in any letter case; the last of equal ids counts.

    These are the genes that `intervals.tandem` and `intervals.same_strand` take.
    """
    rows = annotation.where(F.lower("type") == "mrna").select(F.col("attr")["ID"].alias("id"), "seqid", "start", "end", "strand", "row_idx").where("id IS NOT NULL")
    return rows.groupBy("id").agg(F.max_by(F.struct("seqid", "start", "end", "strand"), "row_idx").alias("x")).select("id", "x.*")


def coding(annotation: DataFrame, by_comma: bool = False) -> DataFrame:
    """Coding segments (protein, seqid, start, end, strand, row_idx); with by_comma a segment of several parents is one of each."""
    rows = annotation.where(F.col("type") == "CDS").withColumn("protein", parent(F.col("attr")))
    if by_comma:
        rows = rows.withColumn("protein", F.explode(F.split("protein", ",")))
    return rows.select("protein", "seqid", "start", "end", "strand", "row_idx")


def proteins(genome: DataFrame, annotation: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(id, seq): residues of every group of coding segments of one contig, in order of the strand.

    genome: contigs (id, seq), or pieces of them (id, piece, bases) of `width` bases
    as `readers.fasta_pieces` gives them. Contigs are cut into such pieces, and
    segments are joined to the pieces that they touch, so no whole contig is sent
    along with each of them. What lies beyond its contig's end counts for nothing.
    """
    cut = ["piece", "bases"] if "piece" in genome.columns else [F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("piece", "bases")]
    pieces = genome.select(F.col("id").alias("seqid"), *cut)
    piece = lambda at: F.floor((F.col(at) - 1) / width).cast("int")
    parts = coding(annotation).where("start BETWEEN 1 AND end").withColumn("piece", F.explode(F.sequence(piece("start"), piece("end")))).join(pieces, ["seqid", "piece"])
    low, high = F.greatest(F.col("start") - F.col("piece") * width, F.lit(1)), F.least(F.col("end") - F.col("piece") * width, F.lit(width))
    bases = F.substr("bases", low.cast("int"), (high - low + 1).cast("int"))
    cut = parts.select("protein", "strand", F.struct("start", "end", "row_idx", "piece", bases.alias("bases")).alias("part"))
    # a group's strand is that of its segment read first
    whole = cut.groupBy("protein").agg(F.min_by("strand", F.col("part.row_idx")).alias("strand"), F.array_sort(F.collect_list("part")).alias("parts"))
    seq = F.array_join(F.transform("parts", lambda x: x["bases"]), "")
    return whole.select(F.col("protein").alias("id"), translated(F.when(F.col("strand") == "-", reverse_complement(seq)).otherwise(seq)).alias("seq"))


def clean_proteins(found: DataFrame) -> DataFrame:
    """(id, seq) with ids up to the first blank and one trailing stop taken off; sequences with stops or gaps inside go."""
    short = found.select(F.split("id", " ")[0].alias("id"), F.regexp_replace("seq", r"\.$", "").alias("seq"))
    return short.where(F.col("seq").rlike(r"^[^>.][^.-]*$"))


def exon_residues(proteins_: DataFrame, segments: DataFrame, genome: str, observed: bool = True) -> DataFrame:
    """(exonid, proteinid, genome, seqid, start, end, strand, seq, number): each protein cut along its coding segments.

    observed: a segment has int((end - start) / 3) residues, and on the minus
    strand segments run downwards along the reversed protein. Otherwise codons go
    to the segment that holds their first base, downwards on the unreversed
    protein. Exons are numbered over all proteins in order of their ids. Proteins
    without coding segments have no exons; see `without_segments`.
    """
    rows = segments.join(proteins_.select(F.col("id").alias("protein"), F.col("seq").alias("residues")), "protein")
    first = F.min(F.struct("start", "row_idx", "strand")).over(Window.partitionBy("protein"))["strand"]
    rows = rows.withColumn("minus", first != "+").withColumn("along", F.when(F.col("minus"), -F.col("start")).otherwise(F.col("start")))
    tie = F.when(F.col("minus"), -F.col("row_idx")).otherwise(F.col("row_idx"))
    order = Window.partitionBy("protein").orderBy("along", tie)
    if observed:
        rows = rows.withColumn("taken", F.floor((F.col("end") - F.col("start")) / 3.0).cast("long"))
        before = F.coalesce(F.sum("taken").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("offset", before)
    else:
        bases = F.col("end") - F.col("start") + 1
        after = F.sum(bases).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("offset", F.ceil((after - bases) / 3)).withColumn("taken", F.ceil(after / 3) - F.col("offset"))
    read = F.when(F.col("minus") & F.lit(observed), F.reverse("residues")).otherwise(F.col("residues"))
    rows = rows.withColumn("seq", F.substr(read, (F.col("offset") + 1).cast("int"), F.col("taken").cast("int"))).withColumn("rank", F.row_number().over(order))
    # running numbers: exons of the proteins before, from one row a protein
    sizes = rows.groupBy("protein").agg(F.count("*").alias("exons"))
    starts = running_total(sizes, "protein", "exons")
    number = (F.col("before") + F.col("rank") - 1).alias("number")
    exonid = F.concat(F.lit(f"G.{genome}.E."), (F.col("before") + F.col("rank") - 1).cast("string"))
    return rows.join(starts, "protein").select(exonid.alias("exonid"), F.col("protein").alias("proteinid"), F.lit(genome).alias("genome"), "seqid", "start", "end", "strand", "seq", number)


def running_total(rows: DataFrame, key: str, count: str) -> DataFrame:
    """(key, before): the sum of `count` over all smaller keys; keys are dealt by range, one sum a range is gathered."""
    dealt = written(rows.repartitionByRange(key).withColumn("range", F.spark_partition_id()), "ranges")
    within = F.sum(count).over(Window.partitionBy("range").orderBy(key)) - F.col(count)
    ranges = dealt.groupBy("range").agg(F.sum(count).alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.withColumn("start", before).drop("all")
    return dealt.withColumn("within", within).join(F.broadcast(starts), "range").select(key, (F.col("start") + F.col("within")).alias("before"))


def without_segments(proteins_: DataFrame, segments: DataFrame) -> DataFrame:
    """Proteins (id, seq) that no coding segment names."""
    return proteins_.join(segments.select(F.col("protein").alias("id")), "id", "left_anti")


def top_level(features: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, root): the feature without a parent above each feature; a broken or circular chain has none and is left out.

    Paths are halved each round, so their number grows with the logarithm of the depth.
    """
    named = features.select(F.col("attr")["ID"].alias("id"), F.col("attr")["Parent"].alias("up")).where("id IS NOT NULL")
    now = named.withColumn("up", F.coalesce("up", "id")).dropDuplicates(["id"])
    for _ in range(rounds):
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        step = now.join(above, "up").select("id", F.col("next").alias("up"), (F.col("up") != F.col("next")).alias("moved"))
        step = written(step, "parents")
        now = step.select("id", "up")
        if step.where("moved").isEmpty():
            break
    roots = named.where("up IS NULL").select(F.col("id").alias("up"))
    return now.join(roots, "up", "left_semi").select("id", F.col("up").alias("root"))
