import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from textloom.llm import packing as P
from textloom.llm.common import read_table


def tokens(text):
    t = test_tokens.cache = getattr(test_tokens, "cache", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def check(pieces, rows, window=1024):
    """Every id in exactly one piece; sequences gapless and within the window; ids as by the tokenizers library."""
    whole = {}
    for i, text in rows:
        whole.setdefault((i, tuple(tokens(text))), []).append(text)
    sequences, cover = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        cover.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(n for _, n in own) <= window
    assert sorted(sequences) == list(range(len(sequences)))
    for (i, ids), copies in whole.items():
        own = sorted((p.start, p.length, p.ids_crc32) for p in cover[i, len(ids)]
                     if p.ids_crc32 == crc(ids[p.start:p.start + p.length]))
        want = sorted((s, min(window, len(ids) - s), crc(ids[s:s + window])) for s in range(0, len(ids), window))
        assert own == sorted(want * len(copies))
    return sum(window - sum(n for _, n in own) for own in sequences.values()) / max(1, sum(p.length for p in pieces))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tokens():
    for text in ("plain words", "", "  many   spaces\n\n\tand lines", "ünïcödé \U0001F600", P.SPECIAL + "x" + P.SPECIAL, "a" * 3000):
        enc = P._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
        assert enc.encode(text, allowed_special={P.SPECIAL}) + [0] == tokens(text)


def test_whole_table(spark, scratch):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    pieces = P.pack(docs, scratch(), digest=P.ids_crc32).collect()
    assert check(pieces, [(r.doc_id, r.text) for r in docs.collect()]) < 0.01


def test_bins_grow_with_the_pieces(spark, scratch, monkeypatch):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    plain = [tuple(r) for r in P.pack(docs, scratch(), digest=P.ids_crc32).collect()]
    monkeypatch.setattr(P, "BINS", 1)
    monkeypatch.setattr(P, "PER_BIN", 7)
    pieces = P.pack(docs, scratch(), digest=P.ids_crc32).collect()
    check(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    assert len(pieces) == len(plain)


def test_odd_rows(make_docs, odd_rows, scratch):
    docs = make_docs(odd_rows)
    pieces = P.pack(docs, scratch(), digest=P.ids_crc32).collect()
    check(pieces, odd_rows)
    assert P.pack(docs.limit(0), scratch(), digest=P.ids_crc32).count() == 0


def test_real_ids_come_out(make_docs, scratch):
    rows = [(1, "one two three"), (2, None)]
    got = {r.doc_id: list(r.ids) for r in P.pack(make_docs(rows), scratch()).collect()}
    assert got == {1: tokens("one two three"), 2: [0]}


def test_recipes_use_every_piece_once():
    rng = np.random.default_rng(2)
    for n in (0, 1, 17, 5000):
        hist = np.bincount(np.minimum(1023, rng.geometric(0.004, n)), minlength=1024)
        recipes = P.pack_histogram(hist)
        used = np.zeros(1024, np.int64)
        for combo, times in recipes:
            assert sum(combo) <= 1024 and times > 0
            used += times * np.bincount(combo, minlength=1024)
        assert (used == hist).all()
    full = sum(t for c, t in recipes if sum(c) == 1024) / sum(t for _, t in recipes)
    assert full > 0.5
