import gzip
import hashlib
import json
import zlib

import pytest

from locusweave.llm import warc

PAGES = [
    (1, "http://a.example/x", "<html>" + "a" * 1200),
    (2, "http://a.example/ y\r\nX: z", "<html>" + "a" * 1200),
    (9, None, "<html>" + "a" * 1200),
    (3, "http://b.example/", "short"),
    (4, "http://b.example/", "short"),
    (5, "http://b.example/", None),
    (6, "http://b.example/", ""),
    (7, "u", "ü" * 999 + "x"),
    (8, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 100),
    (8, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 100),
    (None, "u", "n" * 1500),
    (None, "u", "m" * 1500),
    (10, "u", "m" * 1500),
]


def make(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    """Brute force over the rows."""
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == raw and p is not None]
        last = max(same, default=None)
        revisit = len(raw) >= 1000 and last is not None and page != last
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    for archive_bytes in (1, warc.ARCHIVE_BYTES):
        folder = f"file://{tmp_path}/{archive_bytes}"
        whole = warc.written(make(spark, PAGES), f"{folder}/whole", archive_bytes=archive_bytes)
        archives = warc.normalised(whole, f"{folder}/members")
        found = warc.read_back(archives, with_payload=True).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected(PAGES)
        assert all(r.payload == (dict((p, h) for p, _, h in PAGES)[r.page_id] or "").encode() for r in found if r.record_type == "response" and r.page_id is not None)
        assert any(r.url == "http://a.example/%20y%0D%0AX:%20z" for r in found)
        for row in archives.collect():  # any reader of several gzip members sees the same records
            data = open(row.path.removeprefix("file://"), "rb").read()
            lines = [json.loads(x) for x in open(row["index"].removeprefix("file://"))]
            assert len(lines) == row.records and lines[0]["offset"] == 0
            assert sum(x["length"] for x in lines) == len(data)
            joined = b"".join(zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31) for x in lines)
            assert joined == gzip.decompress(data) and joined.count(b"WARC-Record-ID") == row.records


def test_damage_is_noticed():
    record = warc.record(1, "u", "response", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None, "d")
    assert list(warc.records(iter([record[:9], record[9:] + record]))) == [record, record]
    for bad in (record[:-3], b"xyz\r\n\r\n", record + b"x"):
        with pytest.raises(warc.WarcError):
            list(warc.records(iter([bad])))
    with pytest.raises(warc.WarcError):
        warc._row(record.replace(b"abc", b"abd"), False)
    import io

    with pytest.raises(warc.WarcError):
        list(warc.inflated(io.BytesIO(gzip.compress(record)[:-9])))


def test_empty_table(spark, tmp_path):
    whole = warc.written(make(spark, []), f"file://{tmp_path}/w")
    assert warc.read_back(warc.normalised(whole, f"file://{tmp_path}/m")).count() == 0


def test_long_pages_and_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "long " * 700_000), (2, "u", "long " * 700_000), (3, "u", "x")]
    df = make(spark, rows)
    for c in ("n", "digest", "same", "latest", "refers_to", "path", "_key", "_salt"):
        df = df.selectExpr("*", f"concat('own ', url) AS `{c}`")
    archives = warc.normalised(warc.written(df, f"file://{tmp_path}/w"), f"file://{tmp_path}/m")
    found = warc.read_back(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected(rows)
