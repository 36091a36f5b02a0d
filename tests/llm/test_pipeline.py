import random

import corpus_pipeline
from locusweave.llm.common import staged

from .conftest import ODD
from .test_setsketch import brute
from .test_language import SAMPLE


def texts(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(SAMPLE))
        text = " ".join(f"{w}{rng.choice(['', '', 'en', 'es'])}" for w in rng.choices(SAMPLE[lang].split(), k=rng.randint(30, 120)))
        rows.append((i, text + (f" bob.{i}@mail.example.com" if i % 5 == 0 else ""), lang, f"s{i % 3}"))
    return rows


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"]


def test_each_stage_acts(spark, documents):
    rng = random.Random(6)
    rows = texts(rng, 120)
    rows += [(500 + i, rows[i][1], rows[i][2], "s1") for i in range(10)]  # copies
    rows += [(600, " ".join("".join(rng.choices("qxzjkvwypg", k=8)) for _ in range(60)), None, "s2"), (601, None, "en", "s0"), (602, "?!", "en", None)]
    docs = documents(rows)
    stage = dict(corpus_pipeline.STAGES)
    known = staged(stage["language_id"](spark, docs, ""), "t")
    assert {r.doc_id for r in known.collect()} == {r[0] for r in rows} - {600, 601, 602}
    single = staged(stage["near_dedup"](spark, known, ""), "t")
    kept = [r for r in rows if r[0] < 600]
    assert {r.doc_id for r in single.collect()} == {c for _, c in brute(kept, 5, 80).values()}
    clean = staged(stage["pii"](spark, single, ""), "t")
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert not any("mail.example.com" in r.text for r in clean.collect())
    mix = staged(stage["mixing"](spark, clean, ""), "t")
    assert mix.columns == docs.columns
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(mix) / words(clean) - 1.5) < 0.05
    pieces = stage["packing"](spark, mix, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mix.collect()}
    assert sum(r.start == 0 for r in pieces) == mix.count()


def test_stages_take_odd_rows_and_empty_tables(spark, documents):
    for docs in (documents([*ODD, *texts(random.Random(1), 30)]), documents([])):
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, ""), "t")
            if name != "packing":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            if name == "near_dedup":
                assert docs.where("text LIKE 'the same text%'").count() <= 1
