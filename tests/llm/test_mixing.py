from collections import Counter

from textloom.llm import mixing as M


def test_rates_reach_the_target(spark, make_docs):
    rows = [(i, "x" * (50 + i % 7), "en", f"s{min(i % 9, 3)}") for i in range(6000)]
    docs = make_docs(rows, extra=False)
    got = M.mix_sources(docs).collect()
    size = Counter()
    for r in got:
        size[r.source] += len(r.text)
    total = sum(len(r[1]) for r in rows)
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(size[s] / (total / 4) - 1) < 0.1
    weighted = M.mix_sources(docs, weights={"s0": 1, "s3": 3}).groupBy("source").count().collect()
    assert {r.source for r in weighted} == {"s0", "s3"}


def test_tiny_sources_reach_the_target(make_docs, monkeypatch):
    """Means far above the inversion table's: 250 and 750 copies a document."""
    monkeypatch.setattr(M, "COPY_BLOCK", 100)
    rows = [(i, "x" * 50, "en", f"s{i % 2}") for i in range(3000)] + [(5000 + i, "y" * 50, "en", "t3") for i in range(3)]
    rows += [(6000, "z" * 50, "en", "t1")]
    docs = make_docs(rows, extra=False)
    got = M.mix_sources(docs).groupBy("source").agg(M.F.sum(M.F.length("text")).alias("size")).collect()
    target = 50 * len(rows) / 4
    assert {r.source for r in got} == {"s0", "s1", "t1", "t3"}
    assert all(abs(r["size"] / target - 1) < 0.1 for r in got)
    one = [r.copy for r in M.mix_sources(docs).where("doc_id = 6000").collect()]
    assert sorted(one) == list(range(1, len(one) + 1))


def test_copies_are_poisson_at_every_mean(make_docs):
    """The variance of the copies equals their mean, below and above the mean of one draw."""
    for many, few, mean in ((2400, 200, 6.5), (2400, 130, 9.73), (6600, 200, 17.0), (99_800, 200, 250.0)):
        rows = [(i, "x" * 20, "en", "big") for i in range(many)] + [(10**6 + i, "y" * 20, "en", "small") for i in range(few)]
        got = M.mix_sources(make_docs(rows, extra=False)).where("source = 'small'").groupBy("doc_id").count().collect()
        n = [r["count"] for r in got] + [0] * (few - len(got))
        average = sum(n) / few
        variance = sum((x - average) ** 2 for x in n) / (few - 1)
        assert abs(average / mean - 1) < 0.12, (mean, average)
        assert 0.65 < variance / mean < 1.4, (mean, variance)


def test_equals_the_sql_with_a_tiny_source(spark, make_docs, tmp_path):
    import duckdb
    rows = [(i, "x" * (20 + i % 9), "en", f"s{i % 3}") for i in range(900)] + [(2000, "one document", "fr", "t1"), (2001, None, "fr", None),
                                                                              (2002, "a b", "de", "t2"), (2002, "a b", "de", "t2")]
    docs = make_docs(rows, extra=False)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = sorted(map(repr, con.execute(M.OP4_SQL + " ORDER BY ALL").fetchall()))
    got = M.mix_sources(docs).select("doc_id", "text", "lang", "source", "n_chars", "copy").collect()
    assert sorted(repr(tuple(r)) for r in got) == want and len(want) > 1000
    assert sum(r.source == "t1" for r in got) > 100


def test_hot_source_among_many(make_docs, monkeypatch):
    docs = make_docs([(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 40}") for i in range(600)], extra=False)
    few = sorted(map(repr, M.mix_sources(docs).collect()))
    monkeypatch.setattr(M, "MAX_BROADCAST_SOURCES", 1)
    monkeypatch.setattr(M, "HOT", 4)
    assert sorted(map(repr, M.mix_sources(docs).collect())) == few


def test_poisson_numbers(spark):
    cdf = spark.range(1).select(M.poisson_cdf(M.F.lit(2.5), 16.0).alias("c")).first().c
    assert abs(cdf[0] - 0.0820849986) < 1e-9 and abs(cdf[3] - 0.757576) < 1e-5 and cdf[-1] > 1 - 1e-12


def test_odd_rows_and_reruns(spark, make_docs, odd_rows):
    docs = make_docs([(*r, "en", None if r[0] == 8 else "s1") for r in odd_rows])
    a, b = (sorted(map(repr, M.mix_sources(docs.repartition(n)).collect())) for n in (1, 7))
    assert a == b
    out = M.mix_sources(docs.selectExpr("*", "9 as copy"))
    assert out.columns == [*docs.columns, "copy"]
    fives = Counter(r.copy for r in out.where("doc_id = 5").collect())
    assert set(fives.values()) <= {2}                       # both equal rows get the same number
    assert M.mix_sources(docs.limit(0)).count() == 0
    assert M.mix_sources(docs, max_rate=0.0).count() == 0


def test_no_python_in_plan(make_docs):
    plan = M.mix_sources(make_docs([(1, "a")], extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_texts_are_dealt_once(make_docs, monkeypatch):
    docs = make_docs([(i, f"t{i}", "en", f"s{i % 40}") for i in range(400)], extra=False)
    plan = M.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    few = sorted(map(repr, M.mix_sources(docs).collect()))
    monkeypatch.setattr(M, "MAX_BROADCAST_SOURCES", 1)
    assert sorted(map(repr, M.mix_sources(docs).collect())) == few
