"""Text functions against Python's own str / re semantics (the behaviour being reproduced)."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import generation as gen

# golden outputs of the cleaning semantics (expected values computed once with Python's str/re)
CLEAN_GOLDEN = [
    ("a\nb", "ab"),
    ("mail me@x.com", "mail me <user> .com"),
    ("see http://a.b/c?d=e). ok", "see <url> ). ok"),
    ("WWW.x.com www.Y.com/z", "www.x.com <url>"),
    ("\xa0x\u3000y", "x y"),
    ("İstanbul ΟΔΟΣ", "i̇stanbul οδος"),
    ("", ""),
    ("  \n", ""),
    ("@a@b", "<user> <user>"),
    ("tab\there", "tabhere"),
    ("(https://q.r]z)", "( <url> ]z)"),
    ("a@ b", "a@ b"),
    ("\x1cq\x1f", "q"),
    ("ẞ ǅ", "ß ǆ"),
]


def test_clean_text_golden(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CLEAN_GOLDEN)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", tx.clean_text(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(CLEAN_GOLDEN))] == [e for _, e in CLEAN_GOLDEN]


def test_whitespace_class_matches_python_on_bmp(spark):
    cps = [c for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in cps], "cp int, ch string")
    rows = df.select("cp", F.col("ch").rlike(f"^{tx.WS_J}$").alias("w")).collect()
    assert all(r.w == chr(r.cp).isspace() for r in rows)


@pytest.mark.parametrize("s", ["", " ", "a", "a b", "a b c", " a  b\n c ", "a　b\xa0c d",
                               "x" * 5000, ("word " * 2000).strip()])
def test_word_tests_match_split(spark, s):
    df = spark.createDataFrame([(s,)], "t string")
    r = df.select(tx.word_count(F.col("t")).alias("n"), tx.has_words(F.col("t"), 3).alias("h3"),
                  tx.has_text(F.col("t")).alias("ht")).first()
    assert r.n == len(s.split())
    assert r.h3 == (len(s.split()) >= 3)
    assert r.ht == (len(s.split()) > 0)


def test_clean_is_idempotent_on_plain_lower_text(spark):
    texts = ["hello   world", "ça  va\tbien", "déjà vu\n encore", "a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select(tx.clean_text(F.col("t")).alias("c"))
    twice = once.select(tx.clean_text(F.col("c")).alias("c"))
    assert [r.c for r in once.collect()] == [r.c for r in twice.collect()]


EXTRACT = [("pre <post>hi there\nall</post> x", "hi there\nall"),
           ("<post>unclosed text here\n", "unclosed text here"),
           ("no tags", "no tags"),
           ("<post></post>abc", ""),
           ("<post>one</post><post>two</post>", "one")]


def test_extract_post(spark):
    df = spark.createDataFrame([(r,) for r, _ in EXTRACT], "raw string")
    got = [r.p for r in df.select(gen.extract_post(F.col("raw")).alias("p")).collect()]
    assert got == [e for _, e in EXTRACT]


# golden post-processing results (None = row dropped for having fewer than 3 words)
POST_GOLDEN = [
    ("Sure! <post>I feel fine today</post> bye", "I feel fine today."),
    ('<post>  "so tired of it all"  ', "so tired of it all."),
    ("User: x Assistant: nothing works anymore", "x  nothing works anymore."),
    ("[INST] p [/INST] ok", None),
    ("a b", None),
    ("<post>why me?</post>", None),
    ("ends with quote ‘yes’", "ends with quote ‘yes’"),
    ("stars here **", "stars here **"),
    ("<post></post>abc def ghi", None),
]


def test_postprocess_golden(spark):
    df = spark.createDataFrame([(i, "d", "minimum", r) for i, (r, _) in enumerate(POST_GOLDEN)],
                               "gen_id long, dataset string, label string, raw_text string")
    got = {r.gen_id: r.text for r in gen.postprocess(df).collect()}
    assert [got.get(i) for i in range(len(POST_GOLDEN))] == [e for _, e in POST_GOLDEN]
