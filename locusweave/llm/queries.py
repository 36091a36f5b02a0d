"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import audit, entropy, infilling, language, media, mixing, neighbours, packing, quality, resharding, setsketch, surrogates, warc
from .common import small_batches


def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query in a session whose batches for Python are small."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


FOUND = {
    "op1_quality": quality.op1_quality,
    "op2_language_id": language.op2_language_id,
    "op3_packing": packing.op3_packing,
    "op4_nearest": neighbours.op4_nearest,
    "op5_mixing": mixing.op5_mixing,
    "op6_cross_entropy": entropy.op6_cross_entropy,
    "op7_warc": warc.op7_warc,
    "op8_surrogates": surrogates.op8_surrogates,
    "op9_near_duplicates": setsketch.op9_near_duplicates,
    "op10_media_columns": media.op10_media_columns,
    "op11_fill_in_middle": infilling.op11_fill_in_middle,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_resharding": resharding.op13_resharding,
    "language_id_pages": language.page_language_id,
}
QUERIES = {name: prepared(query) for name, query in FOUND.items()}

ORACLE_SQL = {"op7_warc": warc.OP7_SQL, "op9_near_duplicates": setsketch.OP9_SQL, "op11_fill_in_middle": infilling.OP11_SQL, "op12_filter_audit": audit.OP12_SQL}
