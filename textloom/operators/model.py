"""TF-IDF top terms per label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tfidf_top_terms(docs: DataFrame, k: int = 10) -> DataFrame:
    """Top-k terms per label by mean TF-IDF over the label's documents: every term of every whole text counts.

    Spark-native TF-IDF (same formula as ``IDF``: ln((N + 1) / (df + 1))). All steps are
    aggregations with map-side combining; the top-k uses a group limit.

    Nothing is keyed by document: a document is one row, so its tokens are sorted in
    the row and a token is the document's first copy of a term when it differs from
    its left neighbour. One aggregation per (label, term) then yields both the term
    sum and the document count, so only map-side partials per (label, term) shuffle,
    never the (document, term) table.
    """
    docs = docs.filter(F.col("label").isNotNull())    # labelled documents only, as after P1
    n_docs = docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_label")) \
                 .withColumn("N", F.sum("n_label").over(Window.partitionBy()))   # one row per label
    s = docs.select("label", F.sort_array(F.split("text_clean", " ")).alias("_s"))
    pairs = F.transform("_s", lambda x, i: F.struct(
        x.alias("term"), F.when(i == 0, 1).when(F.get(F.col("_s"), i - 1) != x, 1)
                          .otherwise(0).alias("first")))
    tfsum = (s.select("label", F.explode(pairs).alias("_p"))
              .groupBy("label", F.col("_p.term").alias("term"))
              .agg(F.count(F.lit(1)).alias("tfsum"), F.sum("_p.first").alias("_ndoc")))
    df = tfsum.groupBy("term").agg(F.sum("_ndoc").alias("df"))
    # Every (label, term) row has a first copy (_ndoc >= 1); reading _ndoc keeps this branch's aggregate equal to the
    # one under ``df``, so both branches reuse one exchange and the texts are exploded once.
    j = tfsum.filter(F.col("_ndoc") > 0).select("label", "term", "tfsum").join(df, "term").join(n_docs, "label")
    idf = F.log((F.col("N") + 1) / (F.col("df") + 1))
    score = j.select("label", "term",
                     F.round(F.col("tfsum") * idf / F.col("n_label"), 6).alias("score"))
    rank = Window.partitionBy("label").orderBy(F.col("score").desc(), F.col("term"))
    return score.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
