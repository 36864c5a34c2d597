import tempfile

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def scratch(spark):
    """Makes scratch folders below a temporary checkpoint folder (session set-up as on a cluster)."""
    from textloom.llm.common import Scratch
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="llm-tests-"))
    return lambda name="test": Scratch(spark, name)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with columns whose names clash with inner ones."""
    def make(rows, extra=True, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0",
                 None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        if extra:
            for name in ("row", "component", "copy_", "key", "kept", "score", "n", "u", "digest", "piece", "rank"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null and repeated ids, one long text, characters beyond the first plane."""
    words = [f"w{i * 7919 % 613}" for i in range(40_000)]
    return [(1, "The quick brown fox jumps over the lazy dog, again and again."), (2, None), (3, ""), (4, " \n\t "),
            (None, "no id at all but some words in here to count"), (None, None), (5, "same row twice " * 9),
            (5, "same row twice " * 9), (6, " ".join(words)), (7, "\U0001F600 \U0001F680 émoji ﬁ ǅ \x00 end"), (8, "12345"),
            (9, "The quick brown fox jumps over the lazy dog, again and again."), (10, "a" * 5000)]
