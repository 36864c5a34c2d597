"""Text expressions built from JVM-side functions only (no Python UDF).

The patterns are plain regular expressions that Java (Spark) and RE2 (DuckDB)
read the same way, so the oracle SQL can reuse them verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Python's str whitespace (``\s`` / ``str.split()`` / ``str.strip()``) over the BMP,
# written out because Java's ``\s`` and ``(?U)\s`` differ from it.
WS_CHARS = (r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = f"[{WS_CHARS}]"
# URL: http(s)://... or www.... up to whitespace or one of < > " ) ]
URL_PATTERN = rf'https?://[^{WS_CHARS}<>")\]]+|www\.[^{WS_CHARS}<>")\]]+'
# -----------------------------------------------------------------------------
# The same classes for Java regex (Spark). ``\p{IsWhite_Space}`` plus U+001C..U+001F
# is exactly the list above (checked on every BMP code point) and is ~3x faster
# in Java than the spelled-out list. The list above is kept for RE2 (the oracle).
WS_J_CHARS = r"\x1c-\x1f\p{IsWhite_Space}"
WS_J = f"[{WS_J_CHARS}]"
NON_WS_J = f"[^{WS_J_CHARS}]"
URL_J = rf'https?://[^{WS_J_CHARS}<>")\]]+|www\.[^{WS_J_CHARS}<>")\]]+'
# ---- fixed values (continued) ------------------------------------------------
# mention: @ followed by word characters (Python \w = letters, digits, underscore)
MENTION_PATTERN = r"@[\p{L}\p{N}_]+"
URL_MARK = " <URL> "
USER_MARK = " <USER> "
# characters a generated post may end with before a period is appended
POST_END_CHARS = (".", "!", "?", '"', "‘", "’", "*")
# prompt residue removed from generated posts, in this order
RESIDUE_TOKENS = ("User:", "Assistant:", "[INST]", "[/INST]")
# -----------------------------------------------------------------------------


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(c, rf"^{WS_J}++|{WS_J}++\z", "")


def strip_chars(c: Column, char_class: str) -> Column:
    """Python ``str.strip(chars)`` for a regex character class."""
    return F.regexp_replace(c, rf"^{char_class}++|{char_class}++\z", "")


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL_J, URL_MARK)


def mask_mentions(c: Column) -> Column:
    return F.regexp_replace(c, MENTION_PATTERN, USER_MARK)


def collapse_ws(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim (``' '.join(s.split())``)."""
    return F.trim(F.regexp_replace(c, f"{WS_J}+", " "))


def clean_text(c: Column, newline_as_space: bool = False) -> Column:
    """String cast, newline/tab removal, URL and mention masks, lower case, whitespace collapse.

    Masking runs before lower-casing, so the marks end up as ``<url>`` / ``<user>``.
    """
    s = c.cast("string")
    # two literal replaces: several times faster than translate() on long texts
    gap = F.lit(" " if newline_as_space else "")
    s = F.replace(F.replace(s, F.lit("\n"), gap), F.lit("\t"), gap)
    s = mask_mentions(mask_urls(s))
    return collapse_ws(F.lower(s))


def char_len(c: Column) -> Column:
    """Length in code points, as BIGINT."""
    return F.length(c).cast("bigint")


def word_count_collapsed(c: Column) -> Column:
    """Word count of a non-empty, already collapsed text."""
    return F.size(F.split(c, " ")).cast("bigint")


def word_count(c: Column) -> Column:
    """``len(s.split())`` for any text: empty or blank text has 0 words."""
    s = collapse_ws(c)
    return F.when(F.length(s) == 0, F.lit(0).cast("bigint")).otherwise(
        F.size(F.split(s, " ")).cast("bigint"))


def has_words(c: Column, n: int) -> Column:
    """``len(s.split()) >= n`` without splitting: one anchored, possessive scan of the first n words."""
    return c.rlike(f"^{WS_J}*+(?:{NON_WS_J}++{WS_J}++){{{n - 1}}}{NON_WS_J}")


def has_text(c: Column) -> Column:
    """At least one non-whitespace character."""
    return c.rlike(NON_WS_J)


def seeded_hash(seed, *cols: Column) -> Column:
    """Deterministic 60-bit hash of ``seed|c1|c2...`` (md5 prefix), same value in DuckDB.

    Used for every seeded choice instead of ``rand()`` so that recomputation after an
    executor loss gives the same rows.
    """
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit("|"), c.cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("bigint")


def hash_sql(seed, *cols: str) -> str:
    """Spark SQL text of :func:`seeded_hash`, for use inside lambda expressions."""
    inner = ", '|', ".join([f"'{seed}'"] + [f"CAST({c} AS STRING)" for c in cols])
    return f"CAST(conv(substring(md5(concat({inner})), 1, 15), 16, 10) AS BIGINT)"
