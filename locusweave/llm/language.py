"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from letter trigram models, counted over all texts that
declare their language and short built-in profiles, which tell languages apart
that no text declares. The declared language (of a column or of markup), the
address suffix and the host are further evidence: how often texts of a language
declare each language or lie under each suffix, and a host's prior, which is
smoothed by its domain's and that by the whole's, are grouped aggregations over
all rows, each row's own share left out of its prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, staged, table, text_slices

#: The class of texts in none of the languages.
UNKNOWN = "und"


@dataclass(frozen=True)
class Languages:
    """languages: the candidates. evidence: trigrams that a text counts as, at most,
    as they depend on each other; strength: rows that a smoothing prior counts as;
    unknown: prior of none of the languages, whose trigrams are as likely as one of
    `odd` times the buckets; least: probability with which a text is kept."""

    languages: tuple[str, ...] = ("de", "en", "es", "fr")
    buckets: int = 4096
    evidence: float = 60.0
    strength: float = 20.0
    unknown: float = 1e-6
    odd: float = 3.0
    least: float = 0.5


# Common words of languages, as a text that declares each.
PROFILES = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer was sagte gibt alle seit muss wurden beim doch jetzt waren drei neue damit bereits da ab ohne sondern selbst ersten nun etwa heute ihren weil ihm menschen groß straße schön möglich lassen zeit gemacht weiter unser leben wurde am ende der stadt die arbeit des mannes und seiner freunde in dem kleinen haus an dem fluss",
    "en": "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just those people how too little state good very make world still see own work life men being here between both under never know same last another while us might great go come since against right came take three states himself few house use during without again place around however home small found thought went say part once high general upon school every the end of the city and the work of the old man with his friends in the little house by the river",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada vida otro después te otros aunque esa eso hace otra gobierno tan durante siempre día tanto ella tres sí dijo sido gran país según menos mundo año antes estado contra sino forma caso nada hacer general estaba poco estos presidente mayor ante unos les algo hacia casa ellos ayer hecho primera mucho mientras además quien momento millones esto hombre están pues hoy lugar nacional trabajo otras mejor nuevo decir algunos entonces todas días debe política cómo casi toda tal luego pasado medio niño señor el final de la ciudad y la obra de su viejo amigo en la pequeña casa junto al río",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux mais comme ou si leur y dont elle deux ces été cette tout nous sa ont même fait ses aussi bien peut on entre sans être encore temps autres ans après depuis lui était avoir faire très sous ainsi moins où donc avant contre leurs plusieurs là faut vers tous toujours autre non chez toute premier pays celui rien dit quand alors notre monde vous jour trois vie cela beaucoup peu part grand quelque années dire jamais moment année homme toutes je leur étaient avait trop prix fois chaque lors point mieux pendant ils grande selon nouvelle français mois aujourd'hui jusque travail place car voir fin sera ville politique nos cas enfants hommes elles mon quelques seulement certains celle marché société parce façon votre pourquoi assez ensuite déjà c'est n'est qu'il d'un d'une l'on s'est la fin de la ville et le travail du vieil homme avec ses amis dans la petite maison au bord de l'eau",
}
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def trigrams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of letter bytes and word borders in lower case, and the row it lies in."""
    low = FOLD[data]
    second = np.zeros(len(data), bool)  # of a Latin-1 capital of two bytes
    second[1:] = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
    low = np.where(second, low + np.uint8(0x20), low)
    low = np.where(LETTER[low], low, np.uint8(32))
    # a border before and after each row
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    at = np.arange(len(data)) + 2 * row + 1
    padded[at] = low
    middle = at[low != 32]
    code = padded[middle - 1].astype(np.uint32) * 65536 + padded[middle].astype(np.uint32) * 256 + padded[middle + 1]
    return ((code * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(buckets), row[low != 32]


def trigram_counts(texts: DataFrame, p: Languages) -> np.ndarray:
    """Trigrams of the texts (declared, text) by declared language and bucket; one small row each reaches the driver."""
    names = list(p.languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), p.buckets), np.int64)
        for batch in batches:
            declared = np.array([names.index(x) if x in names else -1 for x in batch.column(0).to_pylist()])
            for i, j, data, offsets in text_slices(batch, "text"):
                bucket, row = trigrams(data, offsets, p.buckets)
                own = declared[i:j][row]
                ok = own >= 0
                total += np.bincount(own[ok] * p.buckets + bucket[ok], minlength=total.size).reshape(total.shape)
        k, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(total[k, bucket])], ["k", "bucket", "n"])

    labelled = texts.where(F.col("declared").isin(names)).select("declared", "text").mapInArrow(count, "k long, bucket long, n long")
    counts = np.zeros((len(names), p.buckets))
    for k, bucket, n in labelled.groupBy("k", "bucket").agg(F.sum("n")).collect():
        counts[k, bucket] = n
    return counts


def profile_counts(p: Languages) -> np.ndarray:
    """Trigrams of the built-in profiles by language and bucket; none for languages without a profile."""
    counts = np.zeros((len(p.languages), p.buckets))
    for k, name in enumerate(p.languages):
        raw = PROFILES.get(name, "").encode()
        bucket, _ = trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), p.buckets)
        counts[k] = np.bincount(bucket, minlength=p.buckets)
    return counts


def likelihoods(rows: DataFrame, counts: np.ndarray, p: Languages) -> DataFrame:
    """rows plus `n`, its trigrams, and `ll`, log-likelihoods of the text by language and of none; without the text."""
    smooth = counts + 0.05
    model = np.concatenate([np.log(smooth / smooth.sum(1, keepdims=True)), np.full((1, p.buckets), -math.log(p.odd * p.buckets))]).T.copy()
    shared = rows.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in rows.columns if c != "text"]
    width = model.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch, "text"):
                bucket, row = trigrams(data, offsets, p.buckets)
                ll = np.stack([np.bincount(row, shared.value[bucket, k], j - i) for k in range(width)], 1).astype(float)
                part = batch.slice(i, j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * width, pa.int32()), pa.array(ll.ravel()))
                rest = [part.column(part.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.bincount(row, minlength=j - i)), lists], [*columns, "n", "ll"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(work, f"{kinds}, n long, ll array<double>")


def _softmax(logs: Column) -> Column:
    powers = lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(powers(logs), lambda v: v / F.aggregate(powers(logs), F.lit(0.0), lambda a, b: a + b))


def _summed(x: str, width: int) -> Column:
    return F.array(*[F.sum(F.element_at(x, k + 1)) for k in range(width)])


def markup_language(html: Column) -> Column:
    """Primary subtag of the language that the html element declares, in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]{0,2000}?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def identified(rows: DataFrame, p: Languages = Languages()) -> DataFrame:
    """(id, key, language, probability, text_language, kept) of each of the rows (id, text, declared, host).

    declared: a language code or null, other languages and nulls are evidence of
    their own kind; host: a host name or any other name of where a text is from,
    or null. Its last label is the address suffix, the last two are its domain; a
    name without a dot has no suffix. A text without letters (null, empty, marks
    only) has language null and isn't kept. key is a hash of the text: rows of one
    id and text are alike but for their other evidence. Where no row declares a
    language, or none of them declares one of the candidates, its profile is all
    that its text model knows; a candidate without profile is then flat. An empty table gives none.
    """
    names = [*p.languages, UNKNOWN]
    width = len(names)
    declared = F.when(F.col("declared").isin(*p.languages), F.col("declared")).otherwise(F.when(F.col("declared").isNotNull(), "other").otherwise("none"))
    host = F.coalesce(F.col("host"), F.lit(""))
    rows = rows.select("id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"), declared.alias("declared"), host.alias("host"))
    seen = staged(likelihoods(rows, trigram_counts(rows, p) + profile_counts(p), p), "likelihoods")

    prior = math.log((1 - p.unknown) / len(p.languages))
    flat = F.array(*[F.lit(prior)] * len(p.languages), F.lit(math.log(p.unknown)))
    tempered = F.transform("ll", lambda x: x * F.least(F.lit(1.0), p.evidence / F.greatest("n", F.lit(1))))
    seen = seen.withColumn("text_log", tempered).withColumn("own", F.when(F.col("n") > 0, _softmax(F.zip_with("text_log", flat, lambda a, b: a + b))).otherwise(F.array(*[F.lit(0.0)] * width)))
    label = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise("")
    domain = F.substring_index("host", ".", -2)
    seen = staged(seen.withColumns({"suffix": label, "domain": domain}).drop("ll"), "seen")

    whole = np.array(seen.agg(_summed("own", width)).first()[0] or [0.0] * width, float) if not seen.isEmpty() else np.zeros(width)
    total = F.array(*[F.lit(float(x)) for x in whole])
    by_host = seen.groupBy("host").agg(F.first("domain").alias("domain"), _summed("own", width).alias("of_host"))
    by_domain = by_host.groupBy("domain").agg(_summed("of_host", width).alias("of_domain"))
    hosts = staged(by_host.join(by_domain, "domain").drop("domain"), "hosts")

    def shares(column: str) -> DataFrame:
        """log P(value | language) of each value of a column, smoothed by its share of all rows."""
        sums = seen.groupBy(column).agg(_summed("own", width).alias("sums"))
        all_ = max(float(whole.sum()), 1e-9)
        part = F.aggregate("sums", F.lit(0.0), lambda a, b: a + b) / all_
        logs = [F.log((F.element_at("sums", k + 1) + p.strength * (part + 1e-6)) / (float(whole[k]) + p.strength)) for k in range(width)]
        return staged(sums.select(column, F.array(*logs).alias(f"log_{column}")), column)

    found = looked_up(seen.withColumn("spread", F.xxhash64("id", "key")), hosts, "host", "spread")
    for column in ("declared", "suffix"):
        found = looked_up(found, shares(column), column, "spread")
    # each level of the prior without the row's own share, smoothed by the level above
    less = lambda x: F.zip_with(x, "own", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    found = found.withColumns({"level": less(total), "of_domain": less("of_domain"), "of_host": less("of_host")})
    scale = lambda sums, above: F.zip_with(sums, above, lambda a, b: (a + p.strength * b) / (F.aggregate(sums, F.lit(0.0), lambda x, y: x + y) + p.strength))
    found = found.withColumn("level", scale("level", F.transform(flat, F.exp)))
    found = found.withColumn("level", scale("of_domain", "level"))
    found = found.withColumn("level", scale("of_host", "level"))
    logs = F.zip_with("text_log", "level", lambda a, b: a + F.log(b))
    for column in ("declared", "suffix"):
        logs = F.zip_with(logs, f"log_{column}", lambda a, b: a + b)
    found = found.withColumn("logs", logs).withColumn("posterior", _softmax(F.col("logs")))
    best = lambda x: F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(x, F.array_max(x)).cast("int"))
    some = F.col("n") > 0
    out = found.select("id", "key", F.when(some, best(F.col("posterior"))).alias("language"), F.when(some, F.array_max("posterior")).alias("probability"), F.when(some, best(F.col("own"))).alias("text_language"))
    return out.withColumn("kept", F.coalesce((F.col("language") != UNKNOWN) & (F.col("probability") >= p.least), F.lit(False)))


def document_rows(docs: DataFrame) -> DataFrame:
    """Evidence of plain documents: their declared language and their source as host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.lower("lang").alias("declared"), F.col("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: visible text, declared markup language and the host of the address."""
    return pages.select(F.col("page_id").cast("long").alias("id"), visible_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of all documents, and whether it is certain enough to keep them."""
    return identified(document_rows(table(spark, sf_dir, "documents"))).drop("key").withColumnRenamed("id", "doc_id")


def page_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of all pages, by text, markup, address suffix and host."""
    return identified(page_rows(table(spark, sf_dir, "pages"))).drop("key").withColumnRenamed("id", "page_id")
