from collections import Counter

import duckdb

import corpus_pipeline as P
from textloom.llm import mixing, pii
from textloom.llm.common import read_table

from .test_near_dedup import brute as near_brute
from .test_packing import check as packing_check
from .test_pii import brute as pii_brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(repr, df.collect()))


def test_stage_by_stage(spark, scratch):
    docs = read_table(spark, SF, "documents")
    stages, keep = dict(P.STAGES), scratch("pipe")
    assert list(stages) == ["language_id", "near_dedup", "pii", "mixing", "packing"]
    columns = docs.columns

    known = keep.write(stages["language_id"](spark, docs, SF), "a")
    want = docs.where("text rlike '\\\\p{L}'")
    assert known.columns == columns and rows(known) == rows(want)

    single = keep.write(stages["near_dedup"](spark, known, SF), "b")
    heads = {r[0] for r in map(eval, near_brute([(r.doc_id, r.text) for r in known.collect()])) if r[3]}
    assert single.columns == columns and rows(single) == rows(known.where(known.doc_id.isin(list(heads))))

    clean = keep.write(stages["pii"](spark, single, SF), "c")
    before = {r.doc_id: r for r in single.collect()}
    assert clean.columns == columns and clean.count() == len(before)
    model = pii.fit(single)
    for r in clean.collect():
        text = before[r.doc_id].text
        spans = pii.find_all([text], model)[0][1]
        assert set(pii_brute(text)) <= set(spans)
        assert r.text == pii.redact(text, spans) and r.n_chars == len(r.text)

    mixed = keep.write(stages["mixing"](spark, clean, SF), "d")
    con = duckdb.connect()
    con.register("clean", clean.toPandas())
    n = dict(con.sql(f"WITH RECURSIVE {mixing.mix_ctes('clean', 'm').strip()} SELECT doc_id, count(*) FROM m GROUP BY 1").fetchall())
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter(n)
    assert set(rows(mixed)) <= set(rows(clean))

    packed = stages["packing"](spark, mixed, SF).collect()
    assert packing_check(packed, [(r.doc_id, r.text) for r in mixed.collect()]) < 0.05


def test_run_on_odd_rows(spark, make_docs, odd_rows, scratch):
    for table in (make_docs(odd_rows, extra=False), make_docs(odd_rows, extra=False).limit(0)):
        out = table
        for name, stage in P.STAGES:
            out = scratch("odd").write(stage(spark, out, SF), name)
        assert (out.count() > 0) == (table.count() > 0)


def test_registered():
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is P.run and "pipeline" not in E.oracle_sql()
    names = list(E.queries())
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")] == [n for n in names if n.startswith("op")]
