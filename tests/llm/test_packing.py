import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from locusweave.llm import packing, tokens
from locusweave.llm.common import utf8
from locusweave.llm.packing import Packing
from locusweave.llm.tokens import Words, document_ids

from .conftest import ODD, prose


def reference_ids(text):
    model = Tokenizer.from_file(packing.default_tokenizer())
    return np.array([*model.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, found):
    """Every id in exactly one piece, pieces without gaps in their sequences."""
    want = sorted(reference_ids(t).tobytes() for _, t, *_ in rows)
    assert sum(r.length for r in found) == sum(len(w) // 4 for w in want)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r.start == 0 for r in found) == len(rows)
    return sum(r.length for r in found) / 2048 / len(sequences)


def test_ids_equal_the_tokenizer():
    odd = ["it's İstanbul don't we'll <|endoftext|>x a<|startoftext|>", "ΣΑΣ É é ﬁ שּׁ Ǆ", "a\x1cb c　d 12ab 3.4", "", " \n\n x", "x" * 500, "b'%, a%%% ...,", None]
    found = document_ids(packing.default_tokenizer(), *utf8(pa.array(odd)))
    for text, ids in zip(odd, found, strict=True):
        assert ids.tobytes() == reference_ids(text)[:-1].tobytes()


def test_kept_words_are_bounded_and_still_right(monkeypatch):
    monkeypatch.setattr(tokens, "WINDOW", 1 << 12)
    monkeypatch.setattr(tokens, "RECENT", 300)
    words = Words(packing.default_tokenizer(), 1000)
    monkeypatch.setattr(tokens, "kept", lambda name, make: words)
    texts = [f"the same {prose(i, 400)} and {'long' * 30}{i}" for i in range(40)] + [prose(99, 20_000)]
    for text, ids in zip(texts, document_ids("", *utf8(pa.array(texts)), 1), strict=True):
        assert ids.tobytes() == reference_ids(text).tobytes()
    assert len(words.old[0]) + len(words.new[0]) <= 1000 + 300 + 20_000


def test_packs_everything(documents):
    rng = np.random.default_rng(4)
    rows = [(i, prose(i % 7, int(rng.integers(1, 900))), "en", "s") for i in range(300)]
    found = packing.packed(documents(rows, extra=True), with_ids=True).collect()
    assert check(rows, found) > 0.97


def test_odd_rows(documents):
    check(ODD, packing.packed(documents(ODD, extra=True), with_ids=True).collect())


def test_sequences_are_padded(documents):
    pieces = packing.packed(documents([(1, "a b c", "en", "s"), (2, prose(2, 3000), "en", "s")]), with_ids=True)
    for r in packing.sequences(pieces).collect():
        assert len(r.ids) == 4 * (r.tokens if r.tokens & (r.tokens - 1) == 0 else 2048)


def test_empty_table(documents):
    assert packing.packed(documents([])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_program_is_near_its_bound(seed):
    rng = np.random.default_rng(seed)
    demand = rng.integers(0, 200, 128) * (rng.random(128) < 0.4)
    plan = packing.whole_patterns(demand, 128, 2e-4)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all((p * np.arange(1, 129)).sum() <= 128 for p, _ in plan)
    used = sum(n for _, n in plan)
    optimum = packing.linear_program(demand, 128, 0.0)[1].sum()
    assert optimum - 1e-6 <= used <= optimum * 1.001 + 0.3 * (demand > 0).sum()
    assert used <= len(packing.first_fit(demand, 128))


def test_best_pattern_equals_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(20):
        values = rng.random(6)
        worth, counts = packing.best_pattern(values, 11)
        best = [0.0] * 12
        for c in range(1, 12):
            best[c] = max([best[c - 1], *(values[w] + best[c - w - 1] for w in range(6) if w < c)])
        assert abs(worth - best[11]) < 1e-12 and abs((values * counts).sum() - worth) < 1e-9


def test_room_must_fit_step(documents):
    with pytest.raises(ValueError, match="multiple"):
        packing.packed(documents([(1, "a", "en", "s")]), Packing(room=2048, step=5))
