"""Audit of how filters interact: what each removes in every order that they can be applied in.

The words of all texts are exploded and aggregated by (document, word), then by
document, for totals and distincts; the other flags are joined to these. A
document's flags make one of 2^5 masks, and a part's documents are aggregated
into conditional counts of the masks. Whatever an order and step asks for is a
sum of those counts, so the orders cost nothing in the size of the table.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table

#: The filters in the order of their bits, a word, capitals and marks.
FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
CAPITAL = "[A-Z]"
MARK = "[#$%&*|]"
#: Parameters of the filters: least words, least percentage of distinct words, most percentage of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5


def word_totals(rows: DataFrame) -> DataFrame:
    """(id, key, words, distinct) of rows (id, key, text): totals over all rows of one id and key. Texts without words have none."""
    words = rows.select("id", "key", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    by_word = words.groupBy("id", "key", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("id", "key").agg(F.sum("n").alias("words"), F.count("*").alias("distinct"))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, good, toxic, copies): the failures of each document, bit k for filter k, and its labels.

    Rows of one id, text and part are one row here, `copies` says how many. A null
    text is empty: it has no words and fails A alone, and E if a smaller id has an
    empty text. A null part is ''. A null id is neither smaller nor larger than another,
    so such rows neither fail E nor make others fail it, and have no labels; equal
    ids of one text don't fail E by each other. A document with several labels is good or toxic
    if one says so. Other columns are not looked at. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    chars, capitals = F.length("text").cast("long"), F.regexp_count("text", F.lit(CAPITAL)).cast("long")
    flags = docs.select("id", "key", "part", (100 * capitals > MOST_CAPITALS * chars).alias("C"), F.col("text").rlike(MARK).alias("D"), F.sha2("text", 256).alias("digest"))
    flags = staged(flags, "flags").groupBy("id", "key", "digest", "C", "D", "part").agg(F.count("*").alias("copies"))
    # totals are over all rows of one id and key, in any part
    rows = flags.groupBy("id", "key").agg(F.sum("copies").alias("rows"))
    totals = rows.withColumnsRenamed({"id": "_id", "key": "_key"}).join(word_totals(docs.select("id", "key", "text").repartition("id", "key")), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")), "left")
    totals = totals.select("_id", "_key", (F.coalesce("words", F.lit(0)) / F.col("rows")).cast("long").alias("words"), F.coalesce("distinct", F.lit(0)).alias("distinct"))
    # only the smallest id of a text passes E; joining by id as well keeps large groups of copies spread
    firsts = flags.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first")).select(F.col("digest").alias("_digest"), F.col("first").alias("_first"), F.lit(True).alias("is_first"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = flags.join(totals, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    joined = joined.join(firsts, (F.col("id") == F.col("_first")) & (F.col("digest") == F.col("_digest")), "left").join(known, F.col("id") == F.col("_doc"), "left")
    fails = [
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct") < LEAST_DISTINCT * F.col("words"),
        F.col("C"),
        F.col("D"),
        F.col("id").isNotNull() & F.col("is_first").isNull(),
    ]
    mask = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    return joined.select("id", "part", mask.cast("int").alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "copies")


def audited(found: DataFrame) -> DataFrame:
    """One row a part, order and step of rows (part, mask, good, toxic, copies).

    A filter's share over all orders has a closed form: of the orders of a mask's k
    filters each comes first in one of k.
    """
    n, all_masks = len(FILTERS), range(1 << len(FILTERS))
    orders = ["".join(x) for x in permutations(FILTERS)]
    of = lambda flag: F.sum(F.when(flag, F.col("copies")).otherwise(0))
    by_mask = found.groupBy("part", "mask").agg(F.sum("copies").alias("all"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"))
    kinds = ("all", "good", "toxic")
    parts = by_mask.groupBy("part").agg(*[F.sum(F.when(F.col("mask") == m, F.col(kind)).otherwise(0)).alias(f"{kind}_{m}") for kind in kinds for m in all_masks])
    parts = parts.select("part", *[F.array(*[F.col(f"{kind}_{m}") for m in all_masks]).alias(kind) for kind in kinds])
    shares = F.array(*[F.lit(len(orders) // max(bin(m).count("1"), 1)) for m in all_masks])
    rows = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = lambda k: F.instr("filter_order", FILTERS[k])
    bit = sum((F.when(place(k) == F.col("step"), 1 << k).otherwise(0) for k in range(n)), F.lit(0))
    before = sum((F.when(place(k) < F.col("step"), 1 << k).otherwise(0) for k in range(n)), F.lit(0))
    rows = rows.withColumns({"bit": bit, "before": before})

    def total(kind: str, of, times: Column | None = None) -> Column:
        """Documents of the kind whose mask (fails the filter, fails one before) answers to `of`."""
        hit = lambda m: of(m.bitwiseAND(F.col("bit")) != 0, m.bitwiseAND(F.col("before")) != 0)
        n_of = lambda m: F.get(F.col(kind), m) * (F.lit(1) if times is None else F.get(times, m))
        masks = F.sequence(F.lit(0), F.lit(len(all_masks) - 1))
        return F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a + F.when(hit(m), n_of(m)).otherwise(F.lit(0).cast("long")))

    removed = lambda own, before: own & ~before
    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda own, before: ~own & ~before).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda own, before: own & before).alias("redundant"),
        F.get("all", "bit").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", lambda own, before: own, shares).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents, by source."""
    return audited(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM t),
n AS (SELECT doc_id, count(*) AS words, count(DISTINCT word) AS distinct_words FROM w GROUP BY doc_id),
f AS (SELECT t.doc_id, part, coalesce(words, 0) < 50 AS a, 100 * coalesce(distinct_words, 0) < 65 * coalesce(words, 0) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  t.doc_id > min(t.doc_id) OVER (PARTITION BY text) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN labels ON labels.doc_id = t.doc_id),
fails AS (SELECT doc_id, part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM f),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, failed),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
i AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (SELECT g.*, i.*, contains(failed, letter) AS own, length(translate(failed, before, '')) < length(failed) AS earlier FROM g, i),
r AS (SELECT part, filter_order, step, letter,
  coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (own AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = letter), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (own AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM m GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
