"""Readers. All of them read by Spark, so paths may lie in any store it knows; gzip is told by the file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave import schemas
from locusweave.storage import running

#: Bases of a piece of a contig.
PIECE = 1 << 16


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of files plus `row_idx`, which rises with file names and places in them, and `_head`: whether a row begins its file.

    Spark deals files and their splits to partitions by size, so numbers of
    partitions say nothing of order: splits are ranked by file and first byte, one
    row a split, and rows are counted within them.
    """
    file, start = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    placed = rows.select(*rows.columns, file, start).withColumn("_id", F.monotonically_increasing_id())
    splits = placed.groupBy("_file", "_start").agg(F.min("_id").alias("_first"))
    ranked = splits.withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_start")).cast("long") - 1)
    within = F.col("_id") - F.col("_first")
    found = placed.join(F.broadcast(ranked), ["_file", "_start"])
    return found.select(*rows.columns, (F.shiftleft("_rank", 33) + within).alias("row_idx"), ((F.col("_start") == 0) & (within == 0)).alias("_head"))


def last_by(rows: DataFrame, key: str, order: str = "row_idx") -> DataFrame:
    """Of rows of one key, the one read last."""
    struct = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(struct, order).alias("_row")).select("_row.*")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): headers up to the first blank; lines are trimmed of all white space and joined; the last of equal ids wins.

    Text before the first header is dropped, blank lines are skipped; an empty
    file gives no rows. A record is one row, so it must fit a task's memory;
    `fasta_pieces` reads larger ones.
    """
    records = _in_order(spark.read.option("lineSep", "\n>").text(path))
    # only a file's first record still has its own mark; what precedes a mark there is no record
    own = F.when(F.col("value").startswith(">"), F.substr("value", F.lit(2)))
    marked = records.withColumn("record", F.when(F.col("_head"), own).otherwise(F.col("value")))
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.split("record", "\n")
    seq = F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), trimmed), "")
    found = marked.where("record IS NOT NULL").select(F.split(trimmed(lines[0]), " ")[0].alias("id"), seq.alias("seq"), "row_idx")
    return last_by(found, "id").drop("row_idx")


def _fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, at, bases) of the lines of records, of equal ids those of the last one: bases is a trimmed line, at the number of bases before it; a header has none.

    Lines are Spark's own, so a record may cover many splits. Lines are given to
    records, and bases counted within them, by running sums over ranges of lines.
    """
    rows = _in_order(spark.read.text(path))
    header = F.col("value").startswith(">")
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    id_ = F.when(header, F.split(trimmed(F.substr("value", F.lit(2))), " ")[0])
    rows = rows.select("row_idx", "_head", id_.alias("id"), F.when(header, "").otherwise(trimmed(F.col("value"))).alias("bases"))
    # what precedes a file's first header is a record of no id
    numbered = running(rows, [], ["row_idx"], {"record": (F.col("id").isNotNull() | F.col("_head")).cast("long")})
    counted = running(numbered, ["record"], ["row_idx"], {"upto": F.length("bases").cast("long")})
    known = last_by(numbered.where("id IS NOT NULL").select("id", "record", "row_idx"), "id")
    lines = counted.select("record", "bases", (F.col("upto") - F.length("bases")).alias("at"))
    return lines.join(known.select("id", "record"), "record").select("id", "at", "bases")


def fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(id, length) of all records of `fasta`, none of which is ever one row."""
    return _fasta_lines(spark, path).groupBy("id").agg(F.sum(F.length("bases")).cast("long").alias("length"))


def fasta_pieces(spark: SparkSession, path: str, width: int = PIECE) -> DataFrame:
    """(id, piece, bases): the sequences of `fasta` in pieces of `width` bases, numbered from 0; a record may be larger than a task's memory if its lines aren't."""
    lines = _fasta_lines(spark, path).where("bases <> ''")
    last = F.col("at") + F.length("bases") - 1
    met = lines.withColumn("piece", F.explode(F.sequence(F.floor(F.col("at") / width).cast("int"), F.floor(last / width).cast("int"))))
    low, high = F.greatest(F.col("piece") * F.lit(width).cast("long"), F.col("at")), F.least((F.col("piece") + 1) * F.lit(width).cast("long"), last + 1)
    part = F.substr("bases", (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))
    parts = met.groupBy("id", "piece").agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("bases")))).alias("parts"))
    return parts.select("id", "piece", F.array_join(F.transform("parts", lambda x: x["bases"]), "").alias("bases"))


def attributes(text: Column, decode: bool = False) -> Column:
    """Map of a feature's `key=value;...` text.

    An item without a sign has a null value; of several values split by signs the
    first counts. With decode the whole value counts and percent codes are read.
    The last of equal keys wins.
    """
    items = F.transform(F.split(text, ";"), lambda x: F.split(F.trim(x), "=", 2 if decode else -1))
    values = lambda x: F.when(F.size(x) > 1, F.url_decode(x[1]) if decode else x[1])
    pairs = F.transform(items, lambda x: F.struct(x[0].alias("key"), values(x).alias("value")))
    last = lambda x, i: F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: ~last(x, i)))


def fields(line: Column) -> Column:
    """Fields between tabs; one that begins with a double quote ends with one, may hold tabs, and two quotes in it stand for one."""
    quoted = r'"(?:[^"]|"")*"(?=\t|$)'
    cut = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(rf"\t({quoted}|[^\t]*)"), F.lit(1))
    plain = F.transform(cut, lambda x: F.when(x.rlike(f"^{quoted}"), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(line.contains('"'), plain).otherwise(F.split(line, "\t", -1))


def gff3(spark: SparkSession, path: str, decode: bool = False) -> DataFrame:
    """Annotation rows (seqid, source, type, start, end, score, strand, phase, attr, row_idx); fields may be quoted, lines without exactly nine are skipped."""
    lines = _in_order(spark.read.text(path))
    part = lines.select(fields(F.regexp_replace("value", "\r$", "")).alias("f"), "row_idx").where(F.size("f") == 9)
    names = ("seqid", "source", "type", "start", "end", "score", "strand", "phase")
    columns = [F.col("f")[i].cast("long").alias(n) if n in ("start", "end") else F.col("f")[i].alias(n) for i, n in enumerate(names)]
    return part.select(*columns, attributes(F.col("f")[8], decode).alias("attr"), "row_idx")


def table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Rows of a delimited text with the given schema, plus row_idx; blank lines and those that begin with # are skipped."""
    read = spark.read.schema(schema).option("sep", sep).option("comment", "#").option("mode", "FAILFAST")
    return _in_order(read.csv(path)).drop("_head")


def hits(spark: SparkSession, path: str, schema: str = schemas.HITS) -> DataFrame:
    """Alignments without a header; the schema says which columns there are."""
    return table(spark, path, schema)


def exon_info(spark: SparkSession, path: str) -> DataFrame:
    """Exons; the last of equal ids wins."""
    return last_by(table(spark, path, schemas.EXONS), "exonid").drop("row_idx")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, child1, child2, leaves) of a written tree; node ids are row numbers from 0."""
    rows = table(spark, path, "child1 long, child2 long, leaves string")
    # row_idx holds the split above 33 bits of the place in it: one count a split makes places running numbers
    placed = rows.withColumns({"part": F.shiftright("row_idx", 33), "place": F.col("row_idx").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("before") + F.col("place")
    leaves = F.transform(F.filter(F.split("leaves", ","), lambda x: x != ""), lambda x: x.cast("long"))
    numbered = placed.join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    return numbered.select(number.alias("node_id"), "child1", "child2", leaves.alias("leaves"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, schemas.CLUSTERS)


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a two-column text."""
    return table(spark, path, schemas.MAPPING).drop("row_idx")


def pair_manifest(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, schemas.PAIRS).drop("row_idx")
