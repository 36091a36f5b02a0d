"""Configuration of an analysis and its validation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.schemas import GENOME_1, GENOME_2

# What a configuration holds where it doesn't say otherwise.
DEFAULTS = {"outdir": "./", "blast_params": "", "p": 0.05, "cons_thresh": 1}
GENOME_FIELDS = {"name", "genome", "gff"}


class ValidationError(ValueError):
    """All that is wrong with a configuration."""

    def __init__(self, errors: list[str]) -> None:
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Genome:
    name: str
    genome: str
    gff: str


@dataclass(frozen=True)
class Config:
    genomes: dict[str, Genome]
    outdir: str = DEFAULTS["outdir"]
    p: float = DEFAULTS["p"]
    cons_thresh: float = DEFAULTS["cons_thresh"]
    blast_params: str = DEFAULTS["blast_params"]
    other: dict = field(default_factory=dict)


def parse(text: str) -> Config:
    """A configuration from JSON; its keys override the defaults, without merging below the first level."""
    try:
        raw = DEFAULTS | json.loads(text)
    except (json.JSONDecodeError, TypeError) as e:
        raise ValidationError([f"not a JSON object: {e}"]) from e
    errors, genomes = [], raw.pop("genomes", None)
    if not isinstance(genomes, dict):
        raise ValidationError(["no genomes"])
    if set(genomes) != {GENOME_1, GENOME_2}:
        errors.append(f"genomes must be {GENOME_1} and {GENOME_2}, not {', '.join(sorted(genomes))}")
    for key, value in sorted(genomes.items()):
        if not isinstance(value, dict) or set(value) != GENOME_FIELDS:
            errors.append(f"{key} must have exactly {', '.join(sorted(GENOME_FIELDS))}")
    if not errors:
        names = [genomes[k]["name"] for k in (GENOME_1, GENOME_2)]
        if not all(names) or len(set(names)) < 2:
            errors.append("the names of the genomes must differ and not be empty")
    if errors:
        raise ValidationError(errors)
    known = {k: raw.pop(k) for k in DEFAULTS}
    return Config({k: Genome(**v) for k, v in genomes.items()}, known["outdir"], float(known["p"]), float(known["cons_thresh"]), known["blast_params"], raw)


def load(path: str) -> Config:
    if not Path(path).exists():
        raise ValidationError([f"{path} doesn't exist"])
    return parse(Path(path).read_text())


def contig_mismatch(sequences: DataFrame, annotation: DataFrame) -> DataFrame:
    """(contig, side): contigs that only the sequences (id) or only the annotation (seqid) has."""
    a = sequences.select(F.col("id").alias("a")).where("a IS NOT NULL").distinct()
    b = annotation.select(F.col("seqid").alias("b")).where("b IS NOT NULL").distinct()
    side = F.when(F.col("b").isNull(), "sequence").otherwise("annotation")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").where("a IS NULL OR b IS NULL").select(F.coalesce("a", "b").alias("contig"), side.alias("side"))


def _missing(spark: SparkSession, path: str) -> bool:
    """Whether a path can't be resolved, by Spark's own reader, so in any store that it knows."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return True
    return False


def validate(spark: SparkSession, config: Config) -> None:
    """Raise ValidationError unless all files exist and each genome's files name the same contigs."""
    from locusweave.sources import readers

    errors = []
    for key, genome in sorted(config.genomes.items()):
        missing = [p for p in (genome.genome, genome.gff) if _missing(spark, p)]
        errors += [f"{key}: {p} doesn't exist" for p in missing]
        if not missing:
            odd = contig_mismatch(readers.fasta_lengths(spark, genome.genome), readers.gff3(spark, genome.gff)).limit(5).collect()
            errors += [f"{key}: contig {r.contig} is in the {r.side} only" for r in odd]
    if errors:
        raise ValidationError(errors)
