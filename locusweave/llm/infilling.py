"""Fill-in-the-middle transformation of whole texts, all by built-in functions of Spark SQL.

A text is cut into units, each a word with the white space before it. Two cuts
between units, taken from a hash of the seed and the document's id, make a prefix, a
middle and a suffix; the form says in which order they follow each other, each
after its sentinel. A text that holds a sentinel itself stays plain, so the
sentinels of an arrangement are the only ones in it (they begin with `<`, end with
`>` and hold neither inside, so none can arise across a border either), and the
text can be put together from it again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: A unit of text, and the sentinels before prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Infilling:
    """Parameters: seed of the hash, and the percentages of texts that are rearranged and, of these, with the suffix first (spm)."""

    seed: int = 42
    rate: int = 50
    spm: int = 80


def arranged(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The parts in the order of the form, each after its sentinel; null for no such form."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of; null where its sentinels are not those of the form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    prefix, suffix = F.when(form == "psm", first).otherwise(second), F.when(form == "psm", second).otherwise(first)
    right = (F.size(parts) == 4) & (arranged(form, prefix, middle, suffix) == output)
    return F.when(form == "plain", output).when(right, F.concat(prefix, middle, suffix))


def infilled(docs: DataFrame, p: Infilling = Infilling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) for each row of docs; row has all its columns.

    n counts units. A null text is empty, and an empty one plain; a text of white
    space only is one unit. A null id hashes as an empty one. Repeated rows and
    ids are cut alike as far as their ids and lengths are; nothing depends on
    other rows. Columns of any name pass in row. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), *[group(k).alias(f"h{k + 1}") for k in range(4)])
    own = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | own | (F.col("h3") % 100 >= p.rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < p.spm, "spm").otherwise("psm")
    # a plain text needs no units, only their number
    units = F.when(F.col("form") != "plain", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    n = F.when(F.col("units").isNotNull(), F.size("units")).otherwise(F.regexp_count("text", F.lit(UNIT))).cast("long")
    low, high = (f(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)).cast("int") for f in (F.least, F.greatest))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    cut = rows.withColumn("form", form).withColumn("units", units).withColumn("n", n).withColumns({"low": low, "high": high})
    parts = cut.withColumns({"prefix": part(F.lit(1), F.col("low")), "middle": part(F.col("low") + 1, F.col("high") - F.col("low")), "suffix": part(F.col("high") + 1, F.greatest(F.size("units") - F.col("high"), F.lit(0)))})
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(arranged(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix")))
    return parts.select("row", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents; hashes of the output and of the text put together from it."""
    out = infilled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
g AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
