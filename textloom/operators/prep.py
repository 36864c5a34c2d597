"""Preparation of labelled posts: null filters, cleaning, lengths, first-kept de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import DEFAULT, Config
from textloom.functions import text as tx


def drop_null_posts(df: DataFrame, cols=("text", "label")) -> DataFrame:
    return df.dropna(subset=list(cols))


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.dropna(how="any")


def with_clean_text(df: DataFrame, src: str = "text", cfg: Config = DEFAULT) -> DataFrame:
    return df.withColumn("text_clean", tx.clean_text(F.col(src), cfg.newline_as_space))


def with_lengths(df: DataFrame, col: str = "text_clean") -> DataFrame:
    return (df.withColumn("char_len", tx.char_len(F.col(col)))
              .withColumn("word_len", tx.word_count_collapsed(F.col(col))))


def key_hashes(*cols: str):
    """Two independent 64-bit hashes of the columns; a null differs from every value."""
    parts = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit("second"), *parts).alias("_h2")


def first_ids(df: DataFrame, keys, order_col: str = "doc_id") -> DataFrame:
    """The smallest ``order_col`` of each distinct ``keys``.

    Grouped by 128 hash bits instead of the texts themselves: a hash aggregate on fixed-width values, combined
    map-side, so neither a text nor a key that repeats in a third of all rows goes through the shuffle.
    """
    return (df.select(*key_hashes(*keys), order_col).groupBy("_h1", "_h2")
              .agg(F.min(order_col).alias(order_col)).select(order_col))


def dedup_first(df: DataFrame, keys, order_col: str = "doc_id") -> DataFrame:
    """Exact de-duplication on ``keys`` keeping the row with the smallest ``order_col`` (which identifies a row)."""
    return df.join(first_ids(df, keys, order_col), order_col, "left_semi").select(*df.columns)


def preprocess(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Drop null text/label, clean, drop empty, add lengths, keep first of each (text_clean, label)."""
    return dedup_first(with_lengths(cleaned(df, cfg)), ["text_clean", "label"], "doc_id")


def prepared_ids(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``doc_id, label`` of the rows that ``preprocess`` keeps: what splits, label maps and draws need.

    The label is part of the key, so it comes out of the same aggregate and no text is read twice or moved.
    """
    d = cleaned(df, cfg).select(*key_hashes("text_clean", "label"), "label", "doc_id")
    return d.groupBy("_h1", "_h2", "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label")


def cleaned(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows with text and label, their clean text added."""
    df = drop_null_posts(df)
    # text_clean is empty exactly when the text has no non-whitespace character (masks
    # and lower-casing never turn such a character into whitespace); testing the raw
    # text keeps the cleaning chain out of the pushed-down filter.
    df = df.filter(tx.has_text(F.col("text")))
    return with_clean_text(df, cfg=cfg)
