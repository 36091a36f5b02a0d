import hashlib
import struct
import zlib

import numpy as np
import pytest

from locusweave.llm import media
from locusweave.llm.common import staged

from .conftest import ODD


def filtered(samples, kinds):
    """Brute-force PNG with given row filters."""
    rows, columns = samples.shape
    raw = bytearray()
    for y in range(rows):
        raw.append(kinds[y])
        for x in range(columns):
            a = int(samples[y, x - 1]) if x else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw.append((int(samples[y, x]) - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) & 255)
    return media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", columns, rows, 8, 0, 0, 0, 0)) + media._chunk(b"tEXt", b"x\0y") + media._chunk(b"IDAT", zlib.compress(bytes(raw))) + media._chunk(b"IEND", b"")


def test_all_filters_are_undone():
    samples = np.random.default_rng(1).integers(0, 256, (25, 17), dtype=np.uint8)
    assert (media.decode_png(filtered(samples, [0, 1, 2, 3, 4] * 5)) == samples).all()


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_filters_are_undone(seed):
    rng = np.random.default_rng(seed)
    samples = rng.integers(0, 256, (40, 9), dtype=np.uint8)
    kinds = np.repeat(rng.integers(0, 5, 20), rng.integers(1, 4, 20))[:40].tolist()
    samples = samples[: len(kinds)]
    assert (media.decode_png(filtered(samples, kinds)) == samples).all()


def test_stored_images_hold_several_filters(spark, documents):
    texts = ["plain words of a text that repeat nothing " * 3, "-" * 500, "".join(chr(97 + i % 26) for i in range(52)) + "0123456789AB" * 40, ("x" * 64 + "line of sixty-four letters, which stands again and again, so up.")[:128] * 9]
    rows = media.media_column(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    met = set()
    for r in rows:
        at, parts = 8, []
        while at < len(r.media):
            (n,) = struct.unpack_from(">I", r.media, at)
            if r.media[at + 4 : at + 8] == b"IDAT":
                parts.append(bytes(r.media[at + 8 : at + 8 + n]))
            at += 12 + n
        raw = zlib.decompress(b"".join(parts))
        met |= set(raw[::65])
        assert media.decode_png(r.media).tobytes()[: r.n_bytes].decode() == texts[r.id]
    assert met == {0, 1, 2}


def brute_hash(samples):
    """Means of a 32 by 32 grid by exact area, then cosine sums, one by one."""
    rows, columns = samples.shape

    def overlap(i, n):
        low, high = i * n / 32, (i + 1) * n / 32
        return [max(0.0, min(high, y + 1) - max(low, y)) / (high - low) for y in range(n)]

    down, along = (np.array([overlap(i, n) for i in range(32)]) for n in (rows, columns))
    means = down @ samples.astype(float) @ along.T
    found = [sum(means[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = np.median(found[1:])
    return found, middle


def test_features_equal_brute_force(spark, documents):
    texts = [t for _, t, *_ in ODD if t and len(t) < 5000] + ["a longer text of many words, and more of them; " * 60]
    found = media.media_features(staged(media.media_column(documents([(i, t, "en", "s") for i, t in enumerate(texts)])), "media")).collect()
    for r in found:
        samples = np.frombuffer(media.payload_of(texts[r.id]), np.uint8).reshape(-1, 64)
        image = media.encode_png(samples)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        values, middle = brute_hash(samples)
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(r.feature), np.uint8)).astype(bool)
        for bit, value in zip(bits, values, strict=True):
            assert bit == (value > middle) or abs(value - middle) < 1e-6 * max(map(abs, values))


def test_damage_is_noticed():
    image = media.encode_png(np.arange(128, dtype=np.uint8).reshape(2, 64))
    for bad in (b"x" + image[1:], image[:-13], image[:40], b"", image[:45] + bytes([image[45] ^ 1]) + image[46:]):
        with pytest.raises(media.MediaError):
            media.decode_png(bad)


def test_hash_is_of_low_frequencies():
    picture = np.kron(np.random.default_rng(5).integers(20, 230, (8, 8)), np.ones((12, 8))).astype(np.uint8)
    noisy = np.clip(picture.astype(int) + np.random.default_rng(2).integers(-6, 7, picture.shape), 0, 255).astype(np.uint8)
    bits = lambda s: int(media.cosine_hash(s), 16)
    assert (bits(picture) ^ bits(noisy)).bit_count() <= 12
    assert (bits(picture) ^ bits(picture[::-1])).bit_count() > 12
    assert len(media.cosine_hash(np.zeros((1, 64), np.uint8))) == 16


def test_payloads_round_trip(spark, documents):
    found = media.media_features(staged(media.media_column(documents(ODD, extra=True)), "media")).collect()
    assert len(found) == len(ODD)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in found if r.id == 6}) == 1
    by = {}
    for key, text, *_ in ODD:
        by.setdefault(key, set()).add(text)
    for r in found:
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) in {expected(t) for t in by[r.id]}
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= 64


def expected(text):
    raw = (text or "").encode()
    padded = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
    return len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])


def test_empty_table(documents):
    assert media.media_features(media.media_column(documents([]))).count() == 0
