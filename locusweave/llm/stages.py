"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents that go on.

All of them take rows with nulls in any column, empty and very long texts,
repeated rows and empty tables, and give an empty table for an empty one. Their
tables have the columns of documents, so no other names can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_rows, small_batches, staged
from .language import document_rows, identified
from .mixing import mixed_texts
from .packing import packed
from .setsketch import near_duplicates
from .surrogates import of_session, replaced


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; texts without letters (null, empty, marks only) and in no known language go.

    Rows are judged one by one, so repeated ones fare alike unless their sources
    differ. Null ids are never joined to, so such rows stay. Of two equally likely
    languages either counts, as both keep the document.
    """
    small_batches(spark)
    found = staged(identified(document_rows(docs)), "languages")
    return kept_rows(docs, staged(found.where("NOT kept").select("id", "key"), "rejected"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8), and of repeated rows, the document of the smallest id.

    Texts without words (null, empty, white space) and rows with a null id are
    copies of nothing and stay. Rows of one id and one text count as repeated: one
    of them stays, whatever their other columns are.
    """
    small_batches(spark)
    found = staged(near_duplicates(docs).select("id", "key", "kept"), "groups")
    left = kept_rows(docs, staged(found.where("NOT kept").select("id", "key"), "copies"))
    again = staged(found.where("id IS NOT NULL").groupBy("id", "key").count().where("count > 1").select("id", "key"), "repeated")
    if again.isEmpty():
        return left
    left = staged(left, "left")
    same = (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("key"))
    return kept_rows(left, again).unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; null and empty texts stay as they are, equal texts stay equal."""
    small_batches(spark)
    return replaced(docs, of_session(spark)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each copy of what it takes of a document; n_chars as before.

    A null source is a source. Texts without words have nothing to take and no
    row. Repeated rows and null ids are documents of their own; ties in the seeded
    order are broken by id and size.
    """
    small_batches(spark)
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null or empty text has its end id only, repeated rows are packed each."""
    small_batches(spark)
    return packed(docs).withColumnRenamed("id", "doc_id")
