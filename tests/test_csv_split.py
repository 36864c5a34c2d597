"""The splittable CSV scan against the multi-line reader and a plain state machine, with splits at awkward places."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources import csvio, csvsplit

SCHEMA = T.StructType([T.StructField("i", T.LongType()), T.StructField("t", T.StringType()), T.StructField("u", T.StringType())])


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few dozen bytes: nearly every record lies in several."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}

    def use(n):
        for k in keys:
            spark.conf.set(k, str(n))
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(n, seed):
    rnd = random.Random(seed)
    pieces = ['"', '""', "\n", ",", "a", "bc", " ", "é", "\n\n", '",', ',"', "x" * 30, "NA", "\\"]
    return [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 12))), rnd.choice(["NA", "v", '"', "", "a\nb"])) for i in range(n)]


@pytest.mark.parametrize("size", [17, 64, 301, 1 << 20])
def test_equal_to_the_multi_line_reader(spark, tmp_path, tiny_splits, size):
    path = str(tmp_path / "one")
    csvio.write_csv(spark.createDataFrame(rows(300, size), SCHEMA).coalesce(1), path)
    want = sorted(map(repr, csvio.read_csv(spark, path, SCHEMA).collect()))
    tiny_splits(size)
    got = csvsplit.read_csv(spark, path, SCHEMA)
    assert sorted(map(repr, got.collect())) == want and len(want) == 300
    splits = spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions()
    assert size > 1000 or splits > 8


def test_several_files_and_crlf(spark, tmp_path, tiny_splits):
    for k, sep in enumerate(("\n", "\r\n", "\n")):
        text = sep.join(["i,t,u", *(f'{100 * k + i},"a {i}\n""b"", c",v' for i in range(40)), ""])
        (tmp_path / f"f{k}.csv").write_text(text, newline="")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text("i,t,u\n")
    tiny_splits(50)
    got = sorted((r.i, r.t, r.u) for r in csvsplit.read_csv(spark, str(tmp_path), SCHEMA).collect())
    assert got == [(100 * k + i, f'a {i}\n"b", c', "v") for k in range(3) for i in range(40)]


def test_one_record_over_many_splits_and_a_missing_last_quote(spark, tmp_path, tiny_splits):
    long = "\n".join(f'line {i} with "quotes", commas' for i in range(200))
    body = 'i,t,u\n1,"' + long.replace('"', '""') + '",v\n2,plain,w\n3,"open\nto the end'
    (tmp_path / "x.csv").write_text(body)
    tiny_splits(40)
    got = {r.i: r for r in csvsplit.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA).collect()}
    assert got[1].t == long and got[2].t == "plain" and got[3].t == "open\nto the end" and len(got) == 3


def test_a_header_over_several_lines(spark, tmp_path, tiny_splits):
    (tmp_path / "x.csv").write_text('"i\nnumber","t\n\n\n\ntext",u\n1,a,b\n')
    tiny_splits(5)
    assert [tuple(r) for r in csvsplit.read_csv(spark, str(tmp_path), SCHEMA).collect()] == [(1, "a", "b")]


def test_line_states():
    """Against a character-by-character machine."""
    def plain(line, state):
        field_start = state == csvsplit.OUTSIDE
        i, mode = 0, "start" if field_start else "quoted"
        while i < len(line):
            c = line[i]
            if mode == "start":
                mode = "quoted" if c == '"' else "start" if c == "," else "text"
            elif mode == "text":
                mode = "start" if c == "," else "text"
            elif c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    mode = "text"
            i += 1
        return csvsplit.INSIDE if mode == "quoted" else csvsplit.OUTSIDE

    rnd = random.Random(0)
    for _ in range(3000):
        line = "".join(rnd.choice('"",,ab') for _ in range(rnd.randrange(0, 14)))
        for state in (0, 1):
            assert csvsplit.state_after(line, state) == plain(line, state), (line, state)


def test_states_are_a_prefix_scan(spark):
    rnd = random.Random(2)
    f = [(file, 10 * i, rnd.randrange(2), rnd.randrange(2)) for file in (1, 2) for i in range(60)]
    got = {(r.file, r.start): (r.first, r.last) for r in csvsplit.split_states(
        spark.createDataFrame(f, "file long, start long, from_outside int, from_inside int")).collect()}
    for file in (1, 2):
        state = 0
        for _, start, a, b in sorted(x for x in f if x[0] == file):
            after = (a, b)[state]
            assert got[file, start] == (state, after)
            state = after


def test_no_text_is_shuffled(spark, tmp_path):
    path = str(tmp_path / "one")
    csvio.write_csv(spark.createDataFrame(rows(50, 1), SCHEMA), path)
    df = csvsplit.read_csv(spark, path, SCHEMA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Cartesian" not in plan and "ExistingRDD" not in plan
    assert df.agg(F.count(F.lit(1))).first()[0] == 50
