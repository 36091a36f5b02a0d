"""Command line: python -m locusweave.cli CONFIG [--action ...] [--validate] [--cores N] [--intended].

Without --cores the session is the one that spark-submit or the settings name.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from locusweave import config as configuration
from locusweave.plans import synteny
from locusweave.sources import writers
from locusweave.storage import clear

ACTIONS = ("plot", "tracks", "clusters", "exons", "hits")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="locusweave", description="Significant syntenic clusters of two annotated genomes.")
    parser.add_argument("config", help="JSON file")
    parser.add_argument("-a", "--action", choices=ACTIONS, default="tracks", help="what to make")
    parser.add_argument("-t", "--cores", type=int, help="run in a local session of so many cores")
    parser.add_argument("-v", "--validate", action="store_true", help="validate only")
    parser.add_argument("--intended", action="store_true", help="the documented method instead of the observed one")
    parser.add_argument("--hits", nargs=2, metavar=("AB", "BA"), help="alignment tables to read")
    asked = parser.parse_args(args)
    try:
        config = configuration.load(asked.config)
        builder = SparkSession.builder.appName("locusweave")
        spark = (builder.master(f"local[{asked.cores}]") if asked.cores else builder).getOrCreate()
        configuration.validate(spark, config)
    except configuration.ValidationError as e:
        print("\n".join(e.errors), file=sys.stderr)
        return 1
    if asked.validate:
        return 0
    if asked.action == "exons":
        exons = synteny.exons_of(spark, config, not asked.intended)
        writers.write_fasta(exons.selectExpr("exonid AS id", "seq"), f"{config.outdir}/exons.fasta")
        writers.write_table(exons.drop("seq", "number"), f"{config.outdir}/exons.info", header="exons")
        clear(spark)
        return 0
    analysis = synteny.run(spark, config, not asked.intended, tuple(asked.hits) if asked.hits else None)
    if asked.action == "hits":
        writers.write_pairs(analysis.hits, f"{config.outdir}/hits")
        writers.write_trees(analysis.nodes, f"{config.outdir}/trees")
        writers.write_manifest(writers.pair_manifest(analysis.hits, f"{config.outdir}/hits", f"{config.outdir}/trees"), f"{config.outdir}/pairs")
        clear(spark)
        return 0
    writers.cluster_text(analysis.clusters).write.text(f"{config.outdir}/clusters")
    if asked.action in ("tracks", "plot"):
        for name, text in synteny.plots(spark, config, analysis).items():
            text.write.text(f"{config.outdir}/{name}")
    if asked.action == "plot":
        for name, texts in synteny.drawings(spark, config, analysis).items():
            texts.write.partitionBy("chr").text(f"{config.outdir}/{name}")
    clear(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
