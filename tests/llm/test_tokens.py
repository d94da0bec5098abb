"""Packing and BPE against the library itself."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from parchment.llm import op04_packing as op4
from parchment.llm import op07_bpe as op7

ODD = [
    None, "", " ", "\n", "a", "  two  spaces ", "tab\there\r\nand\n\n\nlines ", " nbsp  x", "don't we'll I'M 12345 !!??", "<|endoftext|> in <|startoftext|>text<|endoftext|>",
    "é ́x Å Å ΑΣ ΣΑΣ", "日本語のテキスト 漢字", "😀😀 a😀b", "x" * 5000, "x" * 30000, " " * 30000 + "y", "ab " * 3000, "\x01 a\x01b \x01", "\x1c\x1d a\x1cb", "un\u0000nul", "ÀÉ" * 700 + "." + "z" * 40, " lead", "trail ", "İstanbul ŞẞSS",
]


def corpus(n=120, seed=3):
    r = random.Random(seed)
    syll = ["on", "the", "é", "ing", "ß", "st", "ou", "!!", "é", ".", ",", "7"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 5)))
    passage = " ".join(word() for _ in range(400))
    out = [*ODD]
    for _ in range(n):
        t = r.choice([" ", "\n", " "]).join(word() for _ in range(r.randint(0, 300)))
        out.append(t + (" " + passage if r.random() < 0.3 else "") + r.choice(["", "\n", " tail"]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length int")


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op4.tokenizer_path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    got = {r.doc_id: r for r in op7.digests(docs).collect()}
    texts = corpus()
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), repr(t)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), repr(t)
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_chunks_small_window(monkeypatch):
    """Cuts nearly everywhere, so that every join needs repair."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(op7, "cuts", lambda b, f=op7.cuts: f(b, 4, 3))
    tok = Tokenizer.from_file(op4.tokenizer_path("word_bpe_49k.json"))
    enc = op7.Chunked(op4.tokenizer_path("word_bpe_49k.json"))
    texts = [t or "" for t in corpus(60, 9)]
    raw = [t.encode() for t in texts]
    got = enc.texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, (n, ids, _) in zip(texts, got):
        want = tok.encode(t, add_special_tokens=False).ids
        assert (n, ids.decode()) == (len(want), " ".join(map(str, want))), repr(t)


def check_packing(got, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op4.tokenizer_path())
    tok.no_truncation()
    per, bins = {}, {}
    for r in got:
        per.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert sorted(per) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        ps = sorted(per[i], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps)))
        assert all(p.length == capacity for p in ps[1:]) and sum(p.length for p in ps) == len(ids)
        for p in ps:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()), repr(t)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    total = sum(r.length for r in got)
    return len(bins), max(-(-total // capacity), best_fit([r.length for r in got], capacity))


def best_fit(lengths, capacity):
    """Bins of best-fit decreasing."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_packing(docs):
    got = op4.pack(docs).collect()
    n, other = check_packing(got, corpus(), 1024)
    assert n <= other


def test_packing_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op4.pack(none).count() == 0 and op7.digests(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_fullest_is_fullest(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(41, int)
    for x in r.integers(1, 41, 9):
        counts[x] += 1
    picks = op4.fullest(counts, 40)
    lengths = np.repeat(np.arange(41), counts).tolist()
    top = lengths.pop()
    sums = {top}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= 40}
    assert sum(k * c for k, c in picks) == max(sums) and all(counts[k] >= c for k, c in picks)
