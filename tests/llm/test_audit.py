import random
import re
from itertools import permutations

import pytest

from locusweave.llm import audit

from .conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    docs = []
    for doc_id, text, _, part in rows:
        text, words = text or "", WORD.findall(text or "")
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": bool(set(text) & set("#$%&*|")),
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in rows),
        }
        good, toxic = (any(d == doc_id and x == 1 for d, *xs in labels for x in [xs[k]]) and doc_id is not None for k in (0, 1))
        docs.append((part or "", fails, good, toxic))
    out, shapley = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed, kept = [d for d in left if d[1][x]], [d for d in left if not d[1][x]]
                unique = sum(d[1][x] and sum(d[1].values()) == 1 for d in docs if d[0] == part)
                out[part, order, step] = [len(kept), len(removed), sum(d[1][x] for d in gone), unique, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shapley[part, x] = shapley.get((part, x), 0) + len(removed)
                gone, left = gone + removed, kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, docs, labels):
    rows = audit.audited(audit.masks(docs, spark.createDataFrame(labels, LABELS))).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(["one", "two", "Three", "four#", "V", "six", "seven", *(f"w{k}" for k in range(80))]) for _ in range(rng.choice([0, 10, 49, 50, 51, 120, 400]))]
        rows.append((i, " ".join(words) if i % 7 else "the same text of all " * 12, "en", rng.choice(["a", "b", None, ""])))
    return rows


@pytest.mark.parametrize("extra", [False, True])
def test_all_orders_against_plain_loops(spark, documents, extra):
    rng = random.Random(5)
    rows = corpus(rng, 150) + ODD + [(8, "x " * 60, "en", "a"), (8, "x " * 60, "en", "b"), (9, "x " * 60, "en", "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    assert found(spark, documents(rows, extra), labels) == brute(rows, labels)


def test_bounds(spark, documents):
    """Exactly at a limit passes."""
    exact = " ".join(f"w{k}" for k in range(65)) + " w0" * 35  # 65 of 100 words
    capitals = "A" * 5 + "a" * 94 + " "
    rows = [(1, exact, "en", "s"), (2, exact + " w0", "en", "s"), (3, capitals, "en", "s"), (4, "A" + capitals, "en", "s")]
    masks = {r["id"]: r["mask"] for r in audit.masks(documents(rows), spark.createDataFrame([], LABELS)).collect()}
    assert masks == {1: 0, 2: 2, 3: 1, 4: 5}


def test_empty_tables(spark, documents):
    assert found(spark, documents([]), []) == {}
    assert found(spark, documents(ODD), []) == brute(ODD, [])
