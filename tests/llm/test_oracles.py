import duckdb
import pytest

from textloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = Q.QUERIES[name](spark, SF)
    want = con.execute(Q.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == \
        sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_names_and_registration():
    assert [int(n[2:].split("_")[0]) for n in Q.QUERIES] == list(range(1, 14))
    assert set(Q.ORACLE) <= set(Q.QUERIES)
