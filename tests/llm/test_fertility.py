import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from textloom.llm import fertility as T
from textloom.llm.common import read_table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_whole_table(spark, scratch):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = T.judge(docs, scratch()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_words, _, _, _, n_repeat = want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n_words < 50 or 100 * n_repeat > 50 * n_words)
        assert not (r.base_failed and r.kept)
    assert sum(r.kept for r in rows) > 0.95 * sum(not r.base_failed for r in rows)


def test_counts_of_random_texts():
    rng = random.Random(3)
    for _ in range(800):
        text = "".join(rng.choice(["a", "b", "a b c ", " ", "\n", "\t", "#", "é", "\x1c", " ", "\x0b", "\U0001F600"])
                       for _ in range(rng.randrange(40)))
        assert T.base_counts(text, text.encode().split()) == brute(text)


def test_token_statistics_word_by_word():
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = [t.encode().split() for t in ("one two one", "", "\U0001F600 \U0001F680 latin ещё", "x" * 500)]
    tokens, share, entropy = T.token_statistics(docs, path)
    for k, words in enumerate(docs):
        ids = [i for w in words for i in sp.encode(w.decode())]
        assert tokens[k] == len(ids)
        if ids:
            p = np.array(list(Counter(ids).values())) / len(ids)
            assert abs(share[k] - sum(map(sp.is_byte, ids)) / len(ids)) < 1e-9
            assert abs(entropy[k] + (p * np.log2(p)).sum()) < 1e-9


def test_bands_reject_what_the_tokeniser_breaks_up(make_docs, scratch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["the", "in", "ing", "er", "on", "st"]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word() for _ in range(120))) for i in range(400)]
    noise = " ".join("".join(chr(rng.randrange(0x1F600, 0x1F640)) for _ in range(6)) + "ab" for _ in range(80))
    rows.append((1000, noise))
    got = {r.doc_id: r for r in T.judge(make_docs(rows), scratch()).collect()}
    assert not got[1000].kept and not got[1000].base_failed and got[1000].byte_share > 0.5
    assert sum(got[i].kept for i in range(400)) == 400


def test_bands_hold_whatever_the_share_of_junk(make_docs, scratch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["the", "in", "ing", "er", "on", "st"]) for _ in range(rng.randrange(1, 4)))
    clean = [(i, " ".join(word() for _ in range(120))) for i in range(450)]
    noise = lambda: " ".join("".join(chr(rng.randrange(0x1F600, 0x1F640)) for _ in range(6)) + "ab" for _ in range(80))
    for n in (1, 9, 50):                                    # 0.2, 2 and 10 per cent
        rows = clean + [(1000 + i, noise()) for i in range(n)]
        got = {r.doc_id: r.kept for r in T.judge(make_docs(rows), scratch()).collect()}
        assert not any(got[1000 + i] for i in range(n))
        assert all(got[i] for i, _ in clean)


def test_odd_rows(make_docs, odd_rows, scratch):
    docs = make_docs(odd_rows)
    got = T.judge(docs, scratch()).collect()
    assert len(got) == len(odd_rows)
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (2, 3, 4, 8))
    assert T.judge(docs.limit(0), scratch()).count() == 0
    assert T.script_of("привет мир abc") == "Cyrillic" and T.script_of("123 !") == "None"
