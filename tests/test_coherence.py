"""Incoherent texts: planted garbled and disordered texts are found, clean and short ones left alone; odd rows."""

import math
import random

import numpy as np

from textloom.operators import coherence as C

SCHEMA = "gen_id long, dataset string, text string"
PEOPLE = ["The old man", "My sister", "A tall stranger", "The young doctor", "Our neighbour", "The tired teacher"]
DEEDS = ["walked slowly to", "looked quietly at", "wrote a letter about", "often thinks of", "never returned from", "bought flowers near"]
PLACES = ["the river bank", "the empty market", "a small village", "the railway station", "her grandmother's house", "the northern mountains"]


def sentence(rnd):
    return f"{rnd.choice(PEOPLE)} {rnd.choice(DEEDS)} {rnd.choice(PLACES)}."


def clean(n, seed=1):
    rnd = random.Random(seed)
    return [" ".join(sentence(rnd) for _ in range(rnd.randrange(4, 12))) for _ in range(n)]


def judged(spark, rows):
    return {r.gen_id: r for r in C.incoherent(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}


def test_planted_texts_are_found_and_clean_ones_left(spark):
    rnd = random.Random(2)
    base = clean(400)
    rows = [(i, "en", t) for i, t in enumerate(base)]
    for i, t in enumerate(clean(20, 3)):
        rows.append((1000 + i, "en", "".join(rnd.sample(t, len(t)))))
        words = t.split(" ")
        rows.append((2000 + i, "en", " ".join(rnd.sample(words, len(words)))))
        rows.append((3000 + i, "en", " ".join("".join(rnd.sample(w, len(w))) for w in words)))
    got = judged(spark, rows)
    reasons = lambda a, b: [got[i].reason for i in range(a, b)]
    assert reasons(0, 400).count("ok") >= 396
    assert reasons(1000, 1020) == ["garbled"] * 20
    assert reasons(3000, 3020) == ["garbled"] * 20
    assert sum(r != "ok" for r in reasons(2000, 2020)) >= 18


def test_bits_equal_a_plain_model(spark):
    texts = clean(20, 5) + ["", None, "a", "\U0001F600\U0001F600 ok ok"]
    got = judged(spark, [(i, "x" if i % 2 else None, t) for i, t in enumerate(texts)])
    for name in ("x", None):
        own = {i: t or "" for i, t in enumerate(texts) if ("x" if i % 2 else None) == name}
        points = sorted({c for t in own.values() for c in t}, key=lambda c: (-sum(t.count(c) for t in own.values()), ord(c)))
        number = {c: k + 1 for k, c in enumerate(points[:C.SYMBOLS])}
        n = np.zeros((C.K, C.K, C.K))
        coded = {i: [0, 0, *[number.get(c, 0) for c in t]] for i, t in own.items()}
        for s in coded.values():
            for a, b, c in zip(s, s[1:], s[2:]):
                n[a, b, c] += 1

        def p(a, b, c):
            out = 1 / C.K
            for row in (n.sum((0, 1)), n.sum(0)[b], n[a, b]):
                kinds = max(1, (row > 0).sum())
                out = (row[c] + kinds * out) / (row.sum() + kinds)
            return out

        for i, s in coded.items():
            r = got[i]
            assert r.n_chars == len(own[i])
            if own[i]:
                want = -sum(math.log2(p(*x)) for x in zip(s, s[1:], s[2:])) / len(own[i])
                assert abs(r.bits - want) < 1e-9
            else:
                assert r.bits is None and r.reason == "ok"


def test_any_partitioning_and_empty_table(spark):
    rows = [(i, f"d{i % 3}", t) for i, t in enumerate(clean(60, 7))]
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(repr, C.incoherent(df.repartition(n)).collect())) for n in (1, 9))
    assert a == b
    assert C.incoherent(df.limit(0)).count() == 0
    assert C.incoherent(df.selectExpr("*", "1 as bits", "2 as reason")).count() == 60
