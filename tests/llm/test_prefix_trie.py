import hashlib
import random
import zlib

from pyspark.sql import types as T

from conftest import SF01
from textloom.llm import prefix_trie as P

CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, family=5, lent=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % lent if lent else 0
        root = c - int(c % family if c >= 0 else -(-c % family))
        seq = tuple(own.get(root, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    return sorted(repr((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, [])), leaves[node],
                        saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
                  for node, m in members.items())


def result(df):
    return sorted(repr(tuple(r)) for r in df.select(*COLUMNS).collect())


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select(*CONV.names).collect()]
    got = P.op11_prefix_trie(spark, SF01)
    assert got.columns == COLUMNS and all(k == ("string" if c == "ends_sha256" else "bigint") for c, k in got.dtypes)
    assert result(got) == brute(rows)


def some(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-40, 400), n):
        for t in range(rnd.choice([1, 2, 3, 4, 9, 12])):
            rows.append((c, t, rnd.choice(["user", "system", None]), rnd.choice(["a", "b", "ü", "", None])))
    return rows


def test_many_rounds_and_salts(spark, scratch, monkeypatch):
    """Contraction to the very end, blocks of three turns, and every parent treated as hot or none."""
    monkeypatch.setattr(P, "BLOCK", 3)
    monkeypatch.setattr(P, "BASE", 60)
    monkeypatch.setattr(P, "CHUNK", 4)
    for seed, hot in ((1, 10), (2, 10**9)):
        monkeypatch.setattr(P, "HOT", hot)
        rows = some(seed, 60)
        assert result(P.conversation_trie(spark.createDataFrame(rows, CONV).repartition(3), scratch())) == brute(rows)


def test_hot_conversation_first_turn_and_copies(spark, scratch, monkeypatch):
    """One conversation, one first turn and one whole conversation with a third of the rows each; no group holds a third."""
    monkeypatch.setattr(P, "BLOCK", 64)
    rows = [(7, t, "user", f"t{t % 50}") for t in range(1500)]
    rows += [(1000 + i, 0, "user", "hello") for i in range(700)] + [(1000 + i, 1, "assistant", f"x{i}") for i in range(700)]
    rows += [(5000 + 5 * i, t, "user", f"same{t}") for i in range(300) for t in range(5)]
    s = scratch()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = P.conversation_trie(spark.createDataFrame(rows, CONV).repartition(5), s)
        assert result(got) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = [r["count"] for r in s.tables["turns"].groupBy("part").count().collect()]
    assert len(parts) > 2 and max(parts) < 2 * sum(parts) / len(parts)


def test_odd_rows(spark, scratch):
    rows = [(1, None, None, None), (1, 2, "user", None), (None, 1, "user", "lost"), (2, 0, "user", "same"), (2, 0, "user", "same"),
            (3, 1, "", ""), (15, 0, "user", "x" * 100_000), (-7, 3, "user", "neg"), (-5, 0, "user", "base"), (4, 5, "user", "\U0001F600")]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as depth", "2 as id", "'z' as size", "3 as `a.b`")
    assert result(P.conversation_trie(df, scratch())) == brute(rows)
    assert P.conversation_trie(df.limit(0), scratch()).count() == 0
    assert P.conversation_trie(df.where("conv_id is null"), scratch()).count() == 0
    plain = P.conversation_trie(df, scratch(), lent=0)
    assert result(plain) == brute(rows, lent=0)
    # ties: any order of the input gives one order
    tie = [(5, 0, "user", x) for x in "abcdef"]
    a, b = (result(P.conversation_trie(spark.createDataFrame(t, CONV), scratch(), lent=0)) for t in (tie, tie[::-1]))
    assert a == b and len(a) == 7


def test_list_rank_of_a_long_list(spark, scratch, monkeypatch):
    monkeypatch.setattr(P, "BASE", 50)
    order = list(range(2000))
    random.Random(4).shuffle(order)
    rows = [(x, order[i + 1] if i + 1 < len(order) else None, 1, x % 3, x) for i, x in enumerate(order)]
    got = P.list_rank(spark.createDataFrame(rows, "id long, nxt long, w0 long, w1 long, w2 long"), scratch()).collect()
    by = {r.id: r for r in got}
    assert len(got) == len(order) and [by[x].s0 for x in order] == list(range(2000))
    assert [by[x].s2 for x in order] == [sum(order[:i]) for i in range(2000)]
