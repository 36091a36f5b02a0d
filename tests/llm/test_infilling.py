import hashlib
import re

import pytest
from pyspark.sql import functions as F

from locusweave.llm import infilling

from .conftest import ODD

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, p=infilling.Infilling()):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= p.rate:
        return len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if h4 % 100 < p.spm:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


TEXTS = ["one two  three\n\nfour ", " \t lead", "a", "<", "<P>", "x <S> y", "<M", "M> <P > <", " no break \u0085 here\x0b\x0cx", "\U0001f600 \U0001f601\U0001f602 ü", "word " * 3000, "<<S <M <P" * 3]


def rows():
    return [(i, TEXTS[i % len(TEXTS)] + (str(i) if i % 3 else ""), "en", "s") for i in range(240)] + ODD


@pytest.mark.parametrize("p", [infilling.Infilling(), infilling.Infilling(seed=7, rate=100, spm=0), infilling.Infilling(rate=0)])
def test_all_rows_against_plain_loops(spark, documents, p):
    out = infilling.infilled(documents(rows(), extra=True), p)
    back = infilling.restored(F.col("output"), F.col("form"))
    found = out.select("row.doc_id", "row.text", "row.key", "n", "form", "prefix_chars", "middle_chars", "output", back.alias("back")).collect()
    assert len(found) == len(rows())
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, p)
        assert r.back == (r.text or "")
    forms = {r.form for r in found}
    assert forms == ({"plain"} if p.rate == 0 else {"plain", "psm"} if p.spm == 0 else {"plain", "psm", "spm"})


def test_wrong_outputs_are_not_restored(spark):
    bad = [("<P>a<S>b", "psm"), ("<S>a<P>b<M>c", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<P>a<S>b<M>c<M>d", "psm"), ("<P>a<S>b<M>c", "spm"), ("a", "other"), (None, "psm")]
    df = spark.createDataFrame(bad, "output string, form string")
    assert [r[0] for r in df.select(infilling.restored(F.col("output"), F.col("form"))).collect()] == [None] * len(bad)


def test_empty_table_and_plan(spark, documents):
    out = infilling.infilled(documents([]))
    assert out.count() == 0
    plan = infilling.infilled(documents(rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
