import random
import zlib
from itertools import product

import pytest

from locusweave.llm import resharding

from .conftest import ODD, prose


def cheapest(supply, demand, cost):
    """Least cost by trying all flows of small integers."""
    best = {tuple(demand): 0}
    for i, s in enumerate(supply):
        nxt = {}
        for left, spent in best.items():
            for give in product(*[range(min(s, d) + 1) for d in left]):
                if sum(give) == s:
                    key, c = tuple(d - g for d, g in zip(left, give)), spent + sum(g * cost(i, j) for j, g in enumerate(give))
                    nxt[key] = min(nxt.get(key, c), c)
        best = nxt
    return best[(0,) * len(demand)]


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        n, m, total = rng.randint(1, 4), rng.randint(1, 4), rng.randint(0, 9)
        supply, demand = [0] * n, [0] * m
        for _ in range(total):
            supply[rng.randrange(n)] += 1
            demand[rng.randrange(m)] += 1
        costs = [[rng.randint(0, 6) for _ in range(m)] for _ in range(n)]
        for cost in (lambda i, j: costs[i][j], lambda i, j: int(i != j)):  # noqa: B023
            sent = resharding.flow(supply, demand, cost)
            assert [sum(x for (i, _), x in sent.items() if i == k) for k in range(n)] == supply
            assert [sum(x for (_, j), x in sent.items() if j == k) for k in range(m)] == demand
            assert sum(x * cost(i, j) for (i, j), x in sent.items()) == cheapest(supply, demand, cost)
    with pytest.raises(ValueError):
        resharding.flow([1], [2])


def test_only_the_excess_moves():
    rng = random.Random(4)
    old = [rng.randint(0, 10**12) for _ in range(40)]
    new = resharding.capacities(sum(old), 16)
    sent = resharding.flow(old, new)
    assert sum(x for (i, j), x in sent.items() if i != j) == sum(max(0, s - (new[i] if i < 16 else 0)) for i, s in enumerate(old))


def test_levelled():
    assert resharding.levelled([-7, 4, 4, 2]) == [0, 1, 2, 0]
    assert resharding.levelled([-9, 1, 8, 5]) == [0, 0, 4, 1]
    assert resharding.levelled([3, 0]) == [3, 0] and resharding.levelled([]) == []


def resharded(spark, df, tmp_path, files, old, shards, block=8):
    """A table of some files, resharded; (rows as read back, manifest rows, rows of the plan)."""
    path = f"{tmp_path}/table of {files}%20files"
    df.repartition(files).sortWithinPartitions("doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    manifest = resharding.files_of(docs, old)
    new = resharding.resharded(docs, manifest, f"file://{tmp_path}/out", shards, block=block)
    return resharding.read_back(docs, new).collect(), new.collect(), manifest.collect()


def size(text):
    return len((text or "").encode()) + 1


def held(found, rows, shards):
    """All rows are there once, slots have no gaps; the sizes of the shards."""
    key = lambda r: str((r[0], r[1], r[2], r[3]))
    assert sorted(key(r.row) for r in found) == sorted(map(key, rows))
    sizes = [0] * shards
    for k in range(shards):
        mine = [r for r in found if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        sizes[k] = sum(size(r.row.text) for r in mine)
    assert all(0 <= r.shard < shards for r in found)
    return sizes


@pytest.mark.parametrize("files, old, shards", [(1, 1, 16), (9, 16, 16), (30, 5, 7), (12, 20, 3)])
def test_sizes_are_near_equal(spark, documents, tmp_path, files, old, shards):
    rng = random.Random(files)
    rows = [(i, prose(i, rng.choice([1, 5, 20, 60, 200])), "en", "s") for i in range(900)] + [(i, None, None, None) for i in range(900, 940)]
    found, _, _ = resharded(spark, documents(rows), tmp_path, files, old, shards)
    sizes = held(found, rows, shards)
    mean = sum(sizes) / shards
    assert max(sizes) - min(sizes) <= 2 * mean / resharding.LONG + 1


def test_balanced_files_stay(spark, documents, tmp_path):
    rows = [(i, prose(i % 40, 40), "en", "s") for i in range(800)]
    df = documents(rows).repartitionByRange(8, "doc_id")
    path = f"{tmp_path}/t"
    df.write.parquet(path)
    docs = spark.read.parquet(path)
    manifest = resharding.files_of(docs, 8)
    runs, sent = resharding.plan(docs, manifest, 8, block=16)
    moved = sum(x for (i, j), x in sent.items() if i != j)
    new = resharding.resharded(docs, manifest, f"file://{tmp_path}/out", 8, block=16)
    assert moved < 0.05 * sum(size(r[1]) for r in rows)
    gone = {r.path for r in runs.collect() if len(r.runs) > 1 or r.runs[0].target != r.shard}
    assert {r.path for r in new.where("NOT moved").collect()} == {r.path for r in manifest.collect()} - gone
    held(resharding.read_back(docs, new).collect(), rows, 8)


def test_odd_rows_clashing_columns_and_long_documents(spark, documents, tmp_path):
    rows = [*ODD, *((i, prose(i, 30), "en", "s") for i in range(20, 60))]
    df = documents(rows, extra=True)
    for c in ("shard", "path", "at", "runs", "slot"):
        df = df.selectExpr("*", f"concat('own ', doc_id) AS `{c}`")
    found, new, _ = resharded(spark, df, tmp_path, 3, 2, 4)
    held(found, rows, 4)
    assert all(r.row.shard in (None, f"own {r.row.doc_id}") for r in found)
    assert sum(r.rows for r in new) == len(rows)


def test_empty_table(spark, documents, tmp_path):
    found, new, files = resharded(spark, documents([]), tmp_path, 1, 4, 4)
    assert found == new == files == []


def test_query(spark, tmp_path):
    from locusweave.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op13_resharding"](spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (size(texts[r.doc_id]), zlib.crc32((texts[r.doc_id] or "").encode()), "bytes", None) for r in found)
    sizes = [sum(r.size for r in found if r.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= max(r.size for r in found)
