import random
import re

from pyspark.sql import functions as F

from locusweave.llm import mixing
from locusweave.llm.mixing import Mix

from .conftest import ODD, prose


def water(sizes, p):
    """Brute-force targets: share by weight, reshare what is above the top."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(order)}
    left, out, open_ = p.share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > p.most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = p.most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def highest_quotients(votes, seats):
    quota = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda k: (votes[k] / (2 * quota[k] + 1), tuple(-x for x in k)))
        quota[best] += 1
    return quota


def test_apportionment_equals_seat_by_seat(spark):
    rng = random.Random(3)
    votes = {(a, b): rng.choice([0.0, 1.0, 1.0, rng.random() * 50, 10.0]) for a in range(12) for b in range(4)}
    df = spark.createDataFrame([(*k, v) for k, v in votes.items()], "a long, b long, votes double")
    for seats in (0, 1, 7, 200, 5000):
        for near in (1, 4096):
            got = {(r.a, r.b): r.quota for r in mixing.apportioned(df, "votes", seats, near).collect()}
            assert got == highest_quotients(votes, seats), (seats, near)


def test_targets_and_taken(spark, documents):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randint(0, 400)), "en", rng.choice(["a", "b", "c", "d", None, "Ω", "z"])) for i in range(400)]
    p = Mix(shard_docs=30)
    out = mixing.mixed(documents(rows, extra=True), p).select("row.doc_id", "row.source", "size", "source_size", "target", mixing.taken(F.col("blocks")).alias("taken")).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = water(sizes, p)
    got = {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        got[r.source] = got.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(got[s] - t) <= max(0.02 * t, 3 * p.block), s
    again = mixing.mixed(documents(rows, extra=True).repartition(7), p).select("row.doc_id", mixing.taken(F.col("blocks")).alias("taken"))
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r.taken) for r in out)


def test_texts_hold_what_is_taken(documents):
    rows = [(i, "\n ".join(f"w{i}_{k}" for k in range(50 + 9 * i)), "en", "ab"[i % 2]) for i in range(40)]
    df = documents(rows)
    taken = dict(mixing.mixed(df).select("row.doc_id", mixing.taken(F.col("blocks"))).collect())
    got = {}
    for r in mixing.mixed_texts(df).collect():
        words = re.findall(mixing.WORD, r.text)
        assert all(w.startswith(f"w{r.doc_id}_") for w in words) and len(set(words)) == len(words)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words)
    assert got == {k: v for k, v in taken.items() if v}


def test_other_columns_pass_as_they_are(spark, documents):
    df = documents([(i, prose(i, 90), "en", "ab"[i % 2]) for i in range(12)], extra=True)
    df = df.withColumn("at", F.expr("timestamp'2020-01-02 01:02:03.456789'")).withColumn("day", F.expr("date'2020-01-02'")).withColumn("_row", F.struct(F.col("doc_id").alias("_text"), F.array(F.lit(1.5), F.lit(None)).alias("x")))
    df = df.withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("dec", F.col("doc_id").cast("decimal(30,2)")).withColumn("raw", F.encode("source", "utf-8"))
    own = {r.doc_id: r.asDict() for r in df.collect()}
    out = mixing.mixed_texts(df)
    assert out.dtypes == df.dtypes
    rows = out.collect()
    assert rows
    for r in rows:
        assert {k: v for k, v in r.asDict().items() if k != "text"} == {k: v for k, v in own[r.doc_id].items() if k != "text"}


def test_odd_rows(documents):
    out = mixing.mixed(documents(ODD, extra=True)).collect()
    assert len(out) == len(ODD) and {r.row.source for r in out} == {None, "s", "t"}
    texts = mixing.mixed_texts(documents(ODD, extra=True))
    assert texts.columns == documents(ODD, extra=True).columns and texts.count() > 0
    assert all(r.blocks == [] for r in out if r.size == 0)


def test_empty_table(documents):
    assert mixing.mixed(documents([])).count() == 0
    assert mixing.mixed_texts(documents([])).count() == 0
