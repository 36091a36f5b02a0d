"""Media columns: lossless grey PNG images in a binary column, and hashes of their low frequencies.

An image is written and read chunk by chunk: every chunk's CRC-32 is tested,
the IDAT chunks are inflated by zlib and the five row filters are undone with
numpy. The hash is the sign pattern of the low-frequency cosine transform
coefficients against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lengths, slices, staged, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a row of the images that hold payloads.
WIDTH = 64
#: Bytes of one IDAT chunk.
IDAT_BYTES = 1 << 20


class MediaError(ValueError):
    """Bytes that are no image of the kind written here, or a damaged one."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _above(x: np.ndarray) -> np.ndarray:
    """Each row's upper neighbour, zeros above the first."""
    return np.concatenate([np.zeros_like(x[:1]), x[:-1]])


def _left(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros_like(x[:, :1]), x[:, :-1]], 1)


def _nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours the one that is nearest to left + up - corner, the earlier one where several are."""
    far = [np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)]
    return np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))


def filtered(samples: np.ndarray, least: int = 16) -> np.ndarray:
    """Rows by the filter among none, left and up that leaves most zeros, which compress best; the first column holds it.

    A filter must leave `least` more zeros than none. The two others are read but not
    written: they can't be undone for all columns at once.
    """
    ways = np.stack([samples, samples - _left(samples), samples - _above(samples)])
    zeros = (ways == 0).sum(2)
    zeros[0] += least
    kind = zeros.argmax(0)
    return np.concatenate([kind[:, None].astype(np.uint8), ways[kind, np.arange(len(samples))]], 1)


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey PNG of a (rows, columns) array; rows are filtered where that helps."""
    rows, columns = samples.shape
    body = zlib.compress(filtered(samples).tobytes(), level)
    idat = b"".join(_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)) + idat + _chunk(b"IEND", b"")


def _along_diagonals(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Samples of rows filtered by 3 or 4: all places of one anti-diagonal depend on the two before only."""
    n, m = rows.shape
    out = np.zeros((n + 1, m + 1), np.int16)
    out[0, 1:] = above
    mean = kinds == 3
    for d in range(n + m - 1):
        i = np.arange(max(0, d - m + 1), min(n, d + 1))
        j = d - i
        left, up, corner = out[i + 1, j], out[i, j + 1], out[i, j]
        guess = np.where(mean[i], (left + up) // 2, _nearest(left, up, corner))
        out[i + 1, j + 1] = (rows[i, j] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _whole_rows(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Samples of rows filtered by 0, 1 or 2: sums along the rows, then down the columns from the last row of 0 or 1."""
    out = rows.copy()
    left, up = kinds == 1, kinds == 2
    out[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    if up.any():
        steps = np.cumsum(np.where(up[:, None], rows, np.uint8(0)), axis=0, dtype=np.uint8)
        last = np.maximum.accumulate(np.where(up, -1, np.arange(len(rows))))
        known = last[up] >= 0
        from_, before = np.where(known[:, None], out[last[up]], above), np.where(known[:, None], steps[last[up]], np.uint8(0))
        out[up] = from_ + steps[up] - before
    return out


def unfiltered(raw: np.ndarray) -> np.ndarray:
    """Samples of filtered rows, whose first column holds each row's filter; runs of alike rows are undone at once."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    if kinds.max(initial=0) > 4:
        raise MediaError(f"row filter {kinds.max()}")
    out, hard = np.empty_like(rows), kinds > 2
    edges = [0, *(np.flatnonzero(hard[1:] != hard[:-1]) + 1).tolist(), len(kinds)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        above = out[a - 1] if a else np.zeros(rows.shape[1], np.uint8)
        out[a:b] = (_along_diagonals if hard[a] else _whole_rows)(kinds[a:b], rows[a:b], above)
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The (rows, columns) samples of an 8-bit grey PNG without interlacing.

    MediaError for anything else: a wrong signature, a chunk that is cut off or
    fails its checksum, missing or surplus image data.
    """
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, size, parts, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise MediaError("cut off")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if at + 12 + n > len(media) or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(media[at + 4 : at + 8 + n]):
            raise MediaError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            columns, rows, *form = struct.unpack(">IIBBBBB", body)
            size = rows, columns
            if form != [8, 0, 0, 0, 0]:
                raise MediaError("only 8-bit grey images without interlacing")
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise MediaError("cut off")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != size[0] * (size[1] + 1):
        raise MediaError("image data of the wrong size")
    return unfiltered(raw.reshape(size[0], size[1] + 1))


def _cosines(n: int, low: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(low)[:, None] * (2 * np.arange(n)[None] + 1) / (2 * n))


def cosine_hash(samples: np.ndarray, side: int = 32, low: int = 8) -> str:
    """Hex of low * low bits: which low-frequency coefficients of the image, reduced to side * side means, exceed their median."""
    means = samples.astype(np.float64)
    for axis in (0, 1):
        n = means.shape[axis]
        edges = np.arange(side + 1) * n / side
        total = np.concatenate([np.zeros_like(np.take(means, [0], axis)), np.cumsum(means, axis)], axis)
        whole, part = np.minimum(edges.astype(np.int64), n), edges - np.floor(edges)
        after = np.take(total, np.minimum(whole + 1, n), axis)
        part = part[:, None] if axis == 0 else part[None]
        at = np.take(total, whole, axis)
        means = np.diff(at + (after - at) * part, axis=axis) * (side / n)
    basis = _cosines(side, low)
    found = (basis @ means @ basis.T).ravel()
    bits = found > np.median(found[1:])
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str | None) -> bytes:
    raw = b"" if text is None else text.encode()
    return raw + b"\0" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every whole text as the samples of a grey image 64 wide.

    A null text counts as empty (n_bytes 0); an empty text is one row of zeros.
    Ids pass as they are, null or repeated; a row in, a row out. No other column
    is read. Texts of any length are held one at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(byte_lengths(batch.column(1))):
                part = batch.slice(i, j - i)
                texts = part.column(1).to_pylist()
                payloads = [payload_of(t) for t in texts]
                media = [encode_png(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for p in payloads]
                n = [0 if t is None else len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, n_bytes long, media binary")


FEATURES = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """A row for each row of media_column(), from the stored bytes alone.

    Raises MediaError where an image is damaged. A null image gives nulls.
    """

    def features(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * 6
        samples = decode_png(media)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(2)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return media.select("id", "n_bytes", "media").mapInArrow(work, FEATURES)


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents as stored images, their digests read back."""
    stored = staged(media_column(table(spark, sf_dir, "documents")), "media")
    return media_features(stored).withColumnRenamed("id", "doc_id")
