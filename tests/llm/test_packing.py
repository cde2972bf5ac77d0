import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lamella.llm import packing

from .conftest import prose

FILE = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    return [np.array(e.ids + [2], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def verify(rows, pieces, window):
    """Every id of every row is in one piece, and every sequence is gapless and fits. Gives tokens and padding."""
    want = defaultdict(list)
    for (doc_id, text), ids in zip(rows, expected([t or "" for _, t in rows]), strict=True):
        want[doc_id].append(ids)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(want)
    for doc_id, own in by_doc.items():
        starts = defaultdict(list)
        for p in own:
            starts[p["start"]].append(p)
        crcs = sorted((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in own)
        whole = []
        for ids in want[doc_id]:
            n, at = len(ids), 0
            while at < n:
                p = next(p for p in starts[at] if p["doc_tokens"] == n and zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"])
                whole.append((at, p["length"], p["ids_crc32"], n))
                at += p["length"]
            assert at == n
        assert sorted(whole) == crcs
    padding = total = 0
    for seq in by_seq.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= window
        total += at
        padding += window - at
    return total, padding


def test_round_trip(docs):
    rows = [(i, prose(i, 20 + 37 * (i % 90))) for i in range(300)]
    total, padding = verify(rows, packing.pack(docs(*rows), FILE).collect(), 4096)
    assert padding < 0.02 * total


def test_small_windows(docs):
    rows = [(i, prose(i, i)) for i in range(60)]
    verify(rows, packing.pack(docs(*rows), FILE, window=64).collect(), 64)


def test_messy_and_empty(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    verify(rows, packing.pack(messy, FILE).collect(), 4096)
    assert packing.pack(empty, FILE).collect() == []


def test_ids_are_the_librarys():
    texts = ["Hello, World! It's 42.", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "© a©b ©", "E\u0301te\u0301 ΣΑΣ İstanbul ﬁ", "\u00a0 \u2003", "a,b.c!? ... !!", "don't DON'T 'S", "x" * 9000, "日本語 テキスト", ""]
    encoder = packing.WordEncoder(FILE)
    for _ in range(2):
        for got, want in zip(encoder.encode(pa.array(texts, pa.large_string())), expected(texts), strict=True):
            assert got == want[:-1].tobytes()


def test_letters_that_give_marks_join_the_marks_behind():
    texts = ["RESMİ. resmi. RESMİ!? İ;", "क़. फ़, ड़ शाड़;", "שׁ. בּ:", "İSTANBUL. TARİHİ, DERSİ:", "RESMİ, RESMİ RESMİ."]
    encoder = packing.WordEncoder(FILE)
    for _ in range(2):
        for got, want in zip(encoder.encode(pa.array(texts, pa.large_string())), expected(texts), strict=True):
            assert got == want[:-1].tobytes()
    words = [a + chr(c) + "." for c in range(0x110000) if chr(c).isalpha() for a in ("", "a")]
    for w, got, want in zip(words, packing.WordEncoder(FILE).word_ids(words), expected(words), strict=True):
        assert got == want[:-1].tobytes(), w


def test_small_memory_gives_the_same_ids():
    texts = [prose(i, 200) + ". Word, word!" for i in range(8)]
    encoder = packing.WordEncoder(FILE, 50)
    for t, want in zip(texts * 2, expected(texts * 2), strict=True):
        assert list(encoder.encode(pa.array([t], pa.large_string()))) == [want[:-1].tobytes()]


def slow_difference(sizes, bins):
    """Largest differencing with whole vectors, for sums only."""
    parts = [sorted([s] + [0] * (bins - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return parts[0]


@pytest.mark.parametrize("bins", [1, 2, 3, 7])
def test_differencing(bins):
    rng = np.random.default_rng(bins)
    sizes = rng.choice(10_000, 40, replace=False) + 1
    sums = np.bincount(packing.difference(sizes, bins), weights=sizes, minlength=bins)
    assert sums.sum() == sizes.sum() and len(sums) == bins
    assert sums.max() - sums.min() <= max(1, 2 * (slow_difference(sizes.tolist(), bins)[0] - slow_difference(sizes.tolist(), bins)[-1]))


def test_windows_rise_with_capacity():
    assert packing.windows(np.array([60, 60, 60]), 100).max() == 2
    assert sorted(np.bincount(packing.windows(np.array([50, 50, 50, 50]), 100)).tolist()) == [2, 2]
