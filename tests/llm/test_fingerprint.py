import hashlib

from textloom.llm import fingerprint as I
from textloom.llm.common import read_table


def edited(rows):
    """Texts with the last third replaced by the start of the next document (ids falling, the last one's next is the first)."""
    ids = sorted({d for d, _ in rows if d is not None}, reverse=True)
    text = {}
    for d, t in rows:
        if d is not None:
            text[d] = min(text.get(d, t or ""), t or "")
    after = {d: ids[(i + 1) % len(ids)] for i, d in enumerate(ids)}
    out = []
    for d, t in rows:
        t = t or ""
        cut = len(t) // 3
        out.append((d, len(t), t[:len(t) - cut] + (text[after[d]][:cut] if d is not None else "")))
    return out


def result(df):
    return sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in df.collect())


def wanted(rows):
    return sorted(repr((d, n, hashlib.sha256(t.encode()).hexdigest())) for d, n, t in edited(rows))


def test_whole_table(spark, scratch):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = I.fingerprints(docs, scratch())
    assert result(found) == wanted(rows)
    got = {r.doc_id: r for r in found.collect()}
    by_text = {}
    for d, t in rows:
        by_text.setdefault(t, set()).add(got[d].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert len({f for fs in by_text.values() for f in fs}) > 0.95 * len(by_text)
    near = sum(r.near_edited for r in got.values()) / len(got)
    apart = sum(r.near_next for r in got.values()) / len(got)
    assert near > 0.3 and apart < 0.02
    assert all(0 <= x <= 1 for r in got.values() for x in (r.near_edited, r.near_next))
    assert all(r.near_edited == 1 for r in got.values() if r.fingerprint == r.edited_fingerprint)


def test_odd_rows(make_docs, odd_rows, scratch):
    docs = make_docs(odd_rows)
    found = I.fingerprints(docs, scratch())
    assert result(found) == wanted([r[:2] for r in odd_rows])
    got = {r.doc_id: r for r in found.collect()}
    assert got[2].near_edited == 1 and got[1].fingerprint == got[9].fingerprint and got[1].fingerprint != got[7].fingerprint
    assert I.fingerprints(docs.limit(0), scratch()).count() == 0


def test_one_document_follows_itself(make_docs, scratch):
    rows = [(4, "abcdefghi")]
    assert result(I.fingerprints(make_docs(rows), scratch())) == wanted(rows)


def test_no_python_in_plan(make_docs, scratch):
    df = I.fingerprints(make_docs([(1, "a b"), (2, "c d")], extra=False), scratch())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
