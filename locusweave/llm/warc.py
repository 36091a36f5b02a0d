"""WARC archives: written as one gzip stream a file, normalised to a member a record.

`written` makes archives of whole-file gzip streams. `normalised` inflates each
such stream once, from front to back, writes every record as a gzip member of
its own and a sidecar index of offsets beside the new archive. `read_back` reads
single members by that index. Files lie in the folder that driver and executors
share and are reached by pyarrow's file systems, so it may be any store they
know. File names hold the task attempt, and only files of finished tasks get
into the manifest, so a lost executor leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.storage import own_dir

from .common import looked_up, staged, table

GZIP = 31
READ_BYTES = 1 << 20
#: Payload bytes of an archive, at which the next one is begun.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3


class WarcError(ValueError):
    """An archive that is cut off or holds something other than WARC records."""


def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, which states the payload's size, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {uri}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a WARC or HTTP header, names in lower case."""
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def inflated(stream) -> Iterator[bytes]:
    """Pieces of what a gzip file holds, however many members it has."""
    inflate = zlib.decompressobj(GZIP)
    while piece := stream.read(READ_BYTES):
        while piece:
            if inflate.eof:
                inflate = zlib.decompressobj(GZIP)
            yield inflate.decompress(piece)
            piece = inflate.unused_data
    if not inflate.eof:
        raise WarcError("the gzip stream is cut off")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of bytes; one is held at a time."""
    held, need = bytearray(), None
    for piece in pieces:
        held += piece
        at = 0
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                if not held.startswith(b"WARC/", at):
                    raise WarcError("no WARC record where one should begin")
                need = end + 4 + int(fields(bytes(held[at:end]))["content-length"]) + 4 - at
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, None
        del held[:at]
    if held:
        raise WarcError("the last record is cut off")


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _new_name(folder: str, k: int) -> str:
    context = TaskContext.get()
    return f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{k}"


def typed(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(page_id, url, html, n, digest, refers_to): refers_to where the page revisits another."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    rows = rows.withColumn("same", F.concat_ws(":", "digest", "n"))
    again = rows.where(F.col("n") >= least).groupBy("same").agg(F.max("page_id").alias("latest"), F.count("*").alias("m")).where("m > 1").drop("m")
    found = looked_up(rows, staged(again, "copies"), "same", "page_id")
    revisits = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return found.select("page_id", "url", "html", "n", "digest", F.when(revisits, F.col("latest")).alias("refers_to"))


def written(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all pages, each file one gzip stream; returns their manifest (path, records).

    A null html is an empty payload, a null url is left out, a null page_id is
    written as such and never referred to. Of equal payloads of at least `least`
    bytes the rows of the largest page_id are responses (each of them, if it is
    repeated) and the others revisit it; if all their ids are null, all are
    responses. An empty table makes no files.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        out, squeeze, name, size, count, made = None, None, "", 0, 0, []

        def close() -> None:
            out.write(squeeze.flush())
            out.close()
            made.append((name, count))

        for batch in batches:
            for page_id, url, html, n, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, size, count = f"{_new_name(root, len(made))}.warc.gz", 0, 0
                    out, squeeze = store.open_output_stream(name, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                kind = "response" if refers_to is None else "revisit"
                payload = html.encode() if refers_to is None else b""
                out.write(squeeze.compress(record(page_id, url, kind, payload, n, digest, refers_to, date)))
                size, count = size + len(payload), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x.rpartition('/')[2]}" for x, _ in made], pa.string()), pa.array([c for _, c in made], pa.int64())], ["path", "records"])

    rows = typed(pages, id_col, url_col, html_col, least)
    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    return staged(rows.mapInArrow(work, "path string, records long"), "manifest")


def dealt(manifest: DataFrame) -> DataFrame:
    """A task for each file."""
    return manifest.repartitionByRange(max(1, manifest.count()), "path")


def normalised(manifest: DataFrame, folder: str) -> DataFrame:
    """Each archive of the manifest with every record a gzip member, and a sidecar index; returns (path, index, records).

    The index has a line of JSON a record: offset and length of its member, its
    type, id and target. WarcError where an archive is damaged. Records of any
    length are held one at a time; empty payloads, null addresses and repeated
    records stay what they are. A manifest without rows makes no files, and an
    archive without records an empty index. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        k = 0
        for batch in batches:
            made = []
            for path in batch.column(0).to_pylist():
                source, inside = opened(path)
                name, at, count = _new_name(root, k), 0, 0
                k += 1
                with source.open_input_stream(inside, compression=None) as stream, store.open_output_stream(f"{name}.warc.gz", compression=None) as out, store.open_output_stream(f"{name}.index", compression=None) as index:
                    for whole in records(inflated(stream)):
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                        member = squeeze.compress(whole) + squeeze.flush()
                        head = fields(whole[: whole.index(b"\r\n\r\n")])
                        line = {"offset": at, "length": len(member), "type": head.get("warc-type"), "id": head.get("warc-record-id"), "target": head.get("warc-target-uri")}
                        index.write(json.dumps(line).encode() + b"\n")
                        out.write(member)
                        at, count = at + len(member), count + 1
                base = f"{folder}/{name.rpartition('/')[2]}"
                made.append((f"{base}.warc.gz", f"{base}.index", count))
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "index", "records"])

    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    return staged(dealt(manifest).select("path").mapInArrow(work, "path string, index string, records long"), "normalised")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_back(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of normalised archives, each member read by the index.

    The digest of a response is computed from its payload and must equal the one
    that its header states; a revisit has the digest and size that it states.
    Repeated records are returned each, null addresses and page ids as nulls, and
    long records one at a time. No archives: no rows. Other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inside = opened(path)
                rows = []
                with store.open_input_file(inside) as archive, store.open_input_stream(opened(index)[1], compression=None) as lines:
                    for line in _lines(lines):
                        entry = json.loads(line)
                        archive.seek(entry["offset"])
                        whole = zlib.decompress(archive.read(entry["length"]), GZIP)
                        rows.append(_row(whole, with_payload))
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return dealt(archives).select("path", "index").mapInArrow(work, READ)


def _lines(stream) -> Iterator[bytes]:
    held = b""
    while piece := stream.read(READ_BYTES):
        *whole, held = (held + piece).split(b"\n")
        yield from whole


def _row(whole: bytes, with_payload: bool) -> tuple:
    cut = whole.index(b"\r\n\r\n")
    head, block = fields(whole[:cut]), whole[cut + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "response":
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != stated:
            raise WarcError(f"{head['warc-record-id']}: payload digest {digest}, stated {stated}")
    else:
        n, digest = int(fields(http)["content-length"]), stated
    return _page(head["warc-record-id"]), head.get("warc-target-uri"), n, digest, head["warc-type"], _page(head.get("warc-refers-to")), payload if with_payload else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [x.split()[0] for x in READ.split(", ")])


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Contract query: all pages written, normalised and read back."""
    folder = f"{own_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = normalised(written(table(spark, sf_dir, "pages"), f"{folder}/whole"), f"{folder}/members")
    return read_back(archives).drop("url", "payload")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM d
"""
