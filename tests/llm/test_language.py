import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusweave.llm import language
from locusweave.llm.language import Languages, identified

from .conftest import ODD

SAMPLE = {
    "de": "der die und ist nicht mit auf für das ein eine werden können schön über straße groß wenn auch nach",
    "en": "the and is not with for that this have would could which there their about other when also after",
    "es": "el los las una que por para con está también más pero como cuando porque señor niño hacer donde",
    "fr": "le les une des que pour avec dans est pas plus mais être même très où après français cette leur",
}
P = Languages(strength=2.0)


def corpus(rng, n=200):
    rows = []
    for i in range(n):
        lang = rng.choice(list(SAMPLE))
        said = rng.choice(list(SAMPLE)) if rng.random() < 0.1 else lang
        rows.append((i, " ".join(rng.choices(SAMPLE[lang].split(), k=rng.randint(8, 60))), rng.choice([said, said, None]), f"h{i % 5}.{lang}-site.{lang}", lang))
    return rows


SCHEMA = "id long, text string, declared string, host string"


def test_text_outweighs_wrong_declarations(spark):
    rows = corpus(random.Random(1))
    found = {r.id: r for r in identified(spark.createDataFrame([r[:4] for r in rows], SCHEMA), P).collect()}
    assert all(found[r[0]].language == r[4] and found[r[0]].kept for r in rows)


def test_other_evidence_decides_short_texts(spark):
    rows = [r[:4] for r in corpus(random.Random(2))] + [(1000, "a", "fr", "h1.fr-site.fr"), (1001, "a", None, "h1.es-site.es"), (1002, "a", "de", "new.de-site.de")]
    found = {r.id: r.language for r in identified(spark.createDataFrame(rows, SCHEMA), P).collect()}
    assert (found[1000], found[1001], found[1002]) == ("fr", "es", "de")


def test_gibberish_goes(spark):
    rng = random.Random(3)
    junk = ["".join(rng.choices("qxzjkvwypg", k=7)) for _ in range(60)]
    rows = [r[:4] for r in corpus(rng)] + [(1000, " ".join(junk), None, None), (1001, "12 %% 34", "en", "h"), (1002, "", "en", "h"), (1003, None, "en", "h")]
    found = {r.id: r for r in identified(spark.createDataFrame(rows, SCHEMA), P).collect()}
    assert found[1000].language == "und" and not found[1000].kept
    assert all(found[i].language is None and not found[i].kept for i in (1001, 1002, 1003))


def test_evidence_of_pages(spark):
    page = '<!doctype html><HTML class=x lang="de-AT"><script>the and "</p>"</script><!-- the --><p>Straße</p></html>'
    row = spark.createDataFrame([(1, "https://user@www.Site.co.AT:80/x?y", page), (2, "nonsense", "plain"), (3, None, None)], "page_id long, url string, html string")
    got = language.page_rows(row).orderBy("id").collect()
    assert (got[0].declared, got[0].host, got[0].text.split()) == ("de", "www.site.co.at", ["Straße"])
    assert (got[1].declared, got[1].host, got[2].declared, got[2].host) == (None,) * 4


def test_odd_rows(documents):
    df = documents(ODD, extra=True)
    found = identified(language.document_rows(df)).collect()
    assert len(found) == len(ODD)
    same = [r for r in found if r.id == 6]
    assert len(same) == 2 and same[0].language == same[1].language


def test_empty_table(spark):
    assert identified(spark.createDataFrame([], SCHEMA)).count() == 0


def test_capitals_fold_in_trigrams():
    def grams(text):
        raw = text.encode()
        return sorted(language.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 4096)[0].tolist())

    assert grams("ÉTÉ Über ÑU") == grams("été über ñu") and grams("a×b") == grams("a×b") and grams("") == []


def test_counts_are_of_declared_languages(spark):
    df = spark.createDataFrame([("en", "ab"), ("en", "ab"), ("xx", "ab"), (None, "ab"), ("fr", None)], "declared string, text string").select(F.lit(1).alias("id"), "declared", "text")
    counts = language.trigram_counts(df, P)
    assert counts.sum(1).tolist() == [0, 4, 0, 0]


PROSE = {
    "de": "Am nächsten Morgen ging das Mädchen in den Garten, weil die Sonne schien und die Vögel sangen. Ihre Mutter kochte Kaffee und sprach mit dem Nachbarn über das Wetter.",
    "en": "The next morning the girl walked into the garden because the sun was shining and the birds were singing. Her mother made coffee and talked with a neighbour about the weather.",
    "es": "A la mañana siguiente la niña salió al jardín porque brillaba el sol y cantaban los pájaros. Su madre preparaba café y hablaba con el vecino sobre el tiempo.",
    "fr": "Le lendemain matin, la fille sortit dans le jardin parce que le soleil brillait et que les oiseaux chantaient. Sa mère préparait du café et parlait du temps avec le voisin.",
}


def test_no_row_declares_a_language(spark):
    rows = [(i, text, None, None) for i, text in enumerate(PROSE.values())]
    found = {r.id: r for r in identified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(found[i].language, found[i].kept) for i in range(4)] == [(k, True) for k in PROSE]


def test_one_language_is_never_declared(spark):
    rows = [(i, text, None if lang == "es" else lang, None) for i, (lang, text) in enumerate(list(PROSE.items()) * 20)]
    found = {r.id: r for r in identified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all((found[i].language, found[i].kept) == (lang, True) for i, lang in enumerate(list(PROSE) * 20))


def model_of(rows, p):
    """The fusion in plain loops; trigrams alone are taken from the operator."""
    names = list(p.languages)
    grams = []
    for _, text, *_ in rows:
        raw = (text or "").encode()
        grams.append(language.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), p.buckets)[0].tolist())
    counts = [[0.05] * p.buckets for _ in names]
    for k, name in enumerate(names):
        raw = language.PROFILES[name].encode()
        for g in language.trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), p.buckets)[0].tolist():
            counts[k][g] += 1
        for (_, _, declared, _), own in zip(rows, grams, strict=True):
            for g in own if declared == name else ():
                counts[k][g] += 1
    totals = [sum(c) for c in counts]
    flat = [(1 - p.unknown) / len(names)] * len(names) + [p.unknown]

    def normal(logs):
        top = max(logs)
        powers = [math.exp(x - top) for x in logs]
        return [x / sum(powers) for x in powers]

    text_log, own = [], []
    for g in grams:
        ll = [sum(math.log(counts[k][x] / totals[k]) for x in g) for k in range(len(names))] + [-len(g) * math.log(p.odd * p.buckets)]
        text_log.append([x * min(1.0, p.evidence / max(len(g), 1)) for x in ll])
        own.append(normal([a + math.log(b) for a, b in zip(text_log[-1], flat, strict=True)]) if g else [0.0] * (len(names) + 1))
    width = range(len(names) + 1)
    said = [d if d in names else "none" if d is None else "other" for _, _, d, _ in rows]
    hosts = [h or "" for *_, h in rows]
    suffixes = [h.rsplit(".", 1)[1] if "." in h else "" for h in hosts]
    domains = [".".join(h.split(".")[-2:]) for h in hosts]
    summed = lambda some: [sum(own[i][k] for i in some) for k in width]
    all_ = range(len(rows))
    whole = summed(all_)
    out = []
    for i in all_:
        level = flat
        for some in (all_, [j for j in all_ if domains[j] == domains[i]], [j for j in all_ if hosts[j] == hosts[i]]):
            sums = [max(x - y, 0.0) for x, y in zip(summed(some), own[i], strict=True)]
            level = [(x + p.strength * y) / (sum(sums) + p.strength) for x, y in zip(sums, level, strict=True)]
        logs = [a + math.log(b) for a, b in zip(text_log[i], level, strict=True)]
        for values in (said, suffixes):
            sums = summed([j for j in all_ if values[j] == values[i]])
            part = sum(sums) / sum(whole)
            logs = [x + math.log((sums[k] + p.strength * (part + 1e-6)) / (whole[k] + p.strength)) for k, x in enumerate(logs)]
        best = normal(logs)
        k = best.index(max(best))
        out.append(([*names, "und"][k], best[k]) if grams[i] else (None, None))
    return out


def test_fusion_equals_plain_loops(spark):
    rows = [r[:4] for r in corpus(random.Random(8), 60)]
    rows += [(100, "a", "fr", "h1.fr-site.fr"), (101, "a", None, None), (102, "", "en", "x"), (103, None, None, None), (104, "der the el le", "pt", "plain"), (105, "qzx kjw " * 30, "en", "h1.en-site.en"), (105, "qzx kjw " * 30, "en", "h1.en-site.en")]
    want = collections.defaultdict(list)
    for r, w in zip(rows, model_of(rows, P), strict=True):
        want[r[0]].append(w)
    for r in identified(spark.createDataFrame(rows, SCHEMA), P).collect():
        language_, probability = want[r.id].pop()
        assert r.language == language_ and r.probability == (probability and pytest.approx(probability, abs=1e-9)), r
        assert r.kept == bool(language_ not in (None, "und") and probability >= P.least)
