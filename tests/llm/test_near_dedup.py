import random
import re

import numpy as np

from textloom.llm import components as C
from textloom.llm import near_dedup as N
from textloom.llm.common import read_table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows, similarity=85):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1:]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(repr((d, len(sets[i]), least.get(root(i)), d == least[root(i)] if root(i) in least else True))
                  for i, (d, _) in enumerate(rows))


def result(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in df.collect())


def test_whole_table(spark, scratch):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    assert result(N.near_duplicates(docs, scratch())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edited_copies(make_docs, scratch):
    """Groups of copies with 0 to 6 per cent of the words changed, of all sizes, around the threshold."""
    rng = random.Random(7)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 3, 5, 6, 8, 11, 15, 30, 60, 150, 400, 1500]))]
        for _ in range(rng.randrange(1, 9)):
            own = [w if rng.random() > rng.choice([0, 0.005, 0.02, 0.06]) else "new" for w in base]
            if rng.random() < 0.3:
                own.append(f"tail{rng.randrange(9)}")
            rows.append((len(rows) * 3 % 997, " ".join(own).upper() if rng.random() < 0.2 else "\n".join(own)))
    assert result(N.near_duplicates(make_docs([(i, t) for i, t in rows]), scratch())) == brute(rows)


def test_odd_rows(make_docs, odd_rows, scratch):
    docs = make_docs(odd_rows)
    assert result(N.near_duplicates(docs, scratch())) == brute([r[:2] for r in odd_rows])
    kept = N.drop_near_duplicates(docs, scratch())
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, None, None, 5, 6, 7, 8, 10], key=str)
    assert N.near_duplicates(docs.limit(0), scratch()).count() == 0
    assert N.drop_near_duplicates(docs.limit(0), scratch()).count() == 0


def test_one_row_of_few_words(make_docs, scratch):
    for n in range(1, 7):
        text = " ".join(f"w{i}" for i in range(n))
        assert [len(x) for x in N.shingle_sets([text.encode()], N._WordHashes())] == [max(1, n - 4)]
        if n == 3:
            assert result(N.near_duplicates(make_docs([(1, text)], parts=1), scratch())) == brute([(1, text)])


def test_a_common_passage_links_nothing(make_docs, scratch):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60)) + " " + passage) for i in range(300)]
    got = N.near_duplicates(make_docs(rows), scratch())
    assert got.where("kept").count() == 300


def test_slices_meet_whenever_sets_are_linked():
    """No linked pair without a common key, at and just above the threshold, for every size."""
    rng = np.random.default_rng(5)
    for n in [*range(5, 60), 80, 150, 300, 700, 3000]:
        for _ in range(30):
            union = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            differ = int(len(union) * 0.15)
            only = rng.permutation(len(union))[:differ]
            split = rng.integers(0, differ + 1)
            a, b = np.delete(union, only[:split]), np.delete(union, only[split:])
            shared = len(union) - differ
            assert 100 * shared >= 85 * len(union)
            ka, kb = N.slice_keys(a), N.slice_keys(b)
            if len(a) == len(b) == shared:
                continue
            assert len(np.intersect1d(ka, kb)), n


def test_components(spark, scratch):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = C.connected_components(spark.createDataFrame(edges, "a long, b long"), scratch(), "t").collect()
    loose = {a for a, b in edges} | {b for a, b in edges}
    want = {i: root(i) for i in loose}
    assert {r.node: r.label for r in got} == {i: r for i, r in want.items() if any(a != b and i in (a, b) for a, b in edges)}
    assert len(got) == len({r.node for r in got})


def test_value_counts_take_every_text(spark):
    """More texts than any sample: the counts are those of all of them."""
    n = 21_000
    texts = spark.range(n).selectExpr("id as node", "id as label", "concat('a b c d ', id % 3) as text")
    counts = N.value_counts(texts)
    assert counts.sum() == n and sorted(counts[counts > 0].tolist()) == [n // 3] * 3
