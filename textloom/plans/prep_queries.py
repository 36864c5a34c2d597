"""Registered queries of the preparation group (P-rows, A4, A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import prep
from textloom.plans import sqlparts as S
from textloom.sources import tables as tb


def q_drop_null_posts(spark, sf):
    return prep.drop_null_posts(tb.posts(spark, sf))


def q_drop_any_null(spark, sf):
    return prep.drop_any_null(tb.posts(spark, sf))


def q_clean_text(spark, sf):
    d = tb.table(spark, sf, "documents")
    return d.select("doc_id", tx.clean_text(F.col("text")).alias("text_clean"))


def q_mask_urls(spark, sf):
    docs = tb.table(spark, sf, "documents").select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = tb.table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"),
        F.concat_ws(" ", "url", "html").alias("body"))
    return docs.unionByName(pages).select("kind", "id", tx.mask_urls(F.col("body")).alias("masked"))


def q_mask_mentions(spark, sf):
    d = tb.table(spark, sf, "documents")
    return d.select("doc_id", tx.mask_mentions(F.col("text")).alias("masked"))


def q_text_lengths(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", "text").filter(tx.has_text(F.col("text")))
    d = prep.with_clean_text(d)
    return prep.with_lengths(d).select("doc_id", "char_len", "word_len")


def q_dedup_first(spark, sf):
    d = tb.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("dataset"), "text")
    d = prep.with_clean_text(d)
    return prep.dedup_first(d, ["text_clean", "dataset"], "doc_id").select(
        "doc_id", "dataset", "text_clean")


def q_preprocess(spark, sf):
    return prep.preprocess(tb.posts(spark, sf))


QUERIES = {
    "drop_null_posts": q_drop_null_posts,
    "drop_any_null": q_drop_any_null,
    "clean_text": q_clean_text,
    "mask_urls": q_mask_urls,
    "mask_mentions": q_mask_mentions,
    "text_lengths": q_text_lengths,
    "dedup_first": q_dedup_first,
    "preprocess": q_preprocess,
}

_CLEAN = S.clean_text("text")

PREPROCESSED = f"""prep_in AS (
  SELECT doc_id, dataset, text, label, {_CLEAN} AS text_clean FROM posts
  WHERE text IS NOT NULL AND label IS NOT NULL),
prep_len AS (
  SELECT *, CAST(length(text_clean) AS BIGINT) AS char_len,
         CAST(len(string_split(text_clean, ' ')) AS BIGINT) AS word_len
  FROM prep_in WHERE length(text_clean) > 0),
preprocessed AS (
  SELECT doc_id, dataset, text, label, text_clean, char_len, word_len FROM (
    SELECT *, row_number() OVER (PARTITION BY text_clean, label ORDER BY doc_id) AS rn_
    FROM prep_len) WHERE rn_ = 1)"""

ORACLE = {
    "drop_null_posts": S.with_(S.POSTS) + "SELECT * FROM posts WHERE text IS NOT NULL AND label IS NOT NULL",
    "drop_any_null": S.with_(S.POSTS) + """SELECT * FROM posts
      WHERE doc_id IS NOT NULL AND dataset IS NOT NULL AND text IS NOT NULL AND label IS NOT NULL""",
    "clean_text": f"SELECT doc_id, {_CLEAN} AS text_clean FROM documents",
    "mask_urls": f"""SELECT 'doc' AS kind, doc_id AS id, {S.mask_urls('text')} AS masked FROM documents
      UNION ALL
      SELECT 'page' AS kind, page_id AS id, {S.mask_urls("concat_ws(' ', url, html)")} AS masked FROM pages""",
    "mask_mentions": f"SELECT doc_id, {S.mask_mentions('text')} AS masked FROM documents",
    "text_lengths": f"""SELECT doc_id, CAST(length(c) AS BIGINT) AS char_len,
        CAST(len(string_split(c, ' ')) AS BIGINT) AS word_len
      FROM (SELECT doc_id, {_CLEAN} AS c FROM documents) WHERE length(c) > 0""",
    "dedup_first": f"""SELECT doc_id, dataset, text_clean FROM (
        SELECT doc_id, lang AS dataset, {_CLEAN} AS text_clean,
               row_number() OVER (PARTITION BY {_CLEAN}, lang ORDER BY doc_id) AS rn
        FROM documents) WHERE rn = 1""",
    "preprocess": S.with_(S.POSTS, PREPROCESSED) + "SELECT * FROM preprocessed",
}
