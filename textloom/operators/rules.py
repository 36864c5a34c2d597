"""Rule verdicts for sentence completeness and personal data, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as tx

# ---- fixed values: frozen rule specification ---------------------------------
MARKUP_PATTERN = r"<[^>]*>|\[/?INST\]"
# a post that opens with a closing mark, dots, or a bare conjunction or relative word in lower case
FRAGMENT_PATTERN = r"^([,;:)\]]|\.\.|…|(and|or|but|nor|because|although|which|than|whereas) )"
PHONE_PATTERN = r"(\+\d{1,3}[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}|\b\d{3}-\d{4}\b"
ADDRESS_PATTERN = (r"\b\d{1,5} [A-Z][a-z]+( [A-Z][a-z]+)? "
                   r"(St|Street|Ave|Avenue|Rd|Road|Blvd|Lane|Ln|Dr|Drive)\b"
                   r"|\b[A-Z][a-z]+( [A-Z][a-z]+)?, [A-Z][A-Z] \d{5}\b")
NAME_PATTERN = (r"\b(?:[Mm]y name is|I am called|[Ss]igned,|[Cc]ontact|[Rr]egards,|Mr\.|Mrs\.|Ms\.|Dr\.) "
                r"([A-Z][a-z]+ [A-Z][a-z]+)\b")
PLACEHOLDER_NAMES = ("John Doe", "Jane Doe")
# -------------------------------------------------------------------------------

_WORD = "[0-9A-Za-z_]"


def ascii_bounds(pattern: str) -> str:
    """ASCII word boundaries for Java: RE2's ``\\b`` is ASCII, Java 17's is Unicode.

    Every ``\\b`` of the spec sits next to a word character of the pattern, so a
    boundary before it is a negative look-behind and one after it a look-ahead.
    """
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            before = pattern[:i]
            leading = before == "" or before.endswith(("|", "("))
            out.append(f"(?<!{_WORD})" if leading else f"(?!{_WORD})")
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


PHONE_J = ascii_bounds(PHONE_PATTERN)
ADDRESS_J = ascii_bounds(ADDRESS_PATTERN)
NAME_J = ascii_bounds(NAME_PATTERN)
assert re.compile(PHONE_J) and re.compile(ADDRESS_J) and re.compile(NAME_J)


def completeness_reason(post: Column) -> Column:
    """First failing rule (too_short, only_markup, garbled, fragment_start, abrupt_end) or ``ok``.

    Applied to the post before a final period is appended. Pass a column reference:
    the post is used by several rules and must be computed once, upstream.
    """
    markup_left = tx.strip_ws(F.regexp_replace(post, MARKUP_PATTERN, ""))
    letters = F.length(F.regexp_replace(post, r"[^\p{L}]", ""))
    non_ws = F.length(F.regexp_replace(post, tx.WS_J, ""))
    ends = F.substring(post, -1, 1).isin(*tx.POST_END_CHARS)
    return (F.when(~tx.has_words(post, 3), "too_short")
             .when(F.length(markup_left) == 0, "only_markup")
             .when(letters * 2 < non_ws, "garbled")
             .when(post.rlike(FRAGMENT_PATTERN), "fragment_start")
             .when(~ends, "abrupt_end")
             .otherwise("ok"))


#: What every match of a pattern contains: few texts have it, so the captures run on few.
NAME_HINTS = ("y name is ", "I am called ", "igned, ", "ontact ", "egards, ", "Mr. ", "Mrs. ", "Ms. ", "Dr. ")
PHONE_HINT = r"[0-9]{3}\)?[-. ][0-9]{3}"
ADDRESS_HINT = "[0-9] [A-Z][a-z]|[A-Z][A-Z] [0-9]{5}"


def pii_matches(text: Column):
    """(names, phones, addresses) arrays of matches in text order."""
    hint = F.lit(False)
    for cue in NAME_HINTS:
        hint = hint | text.contains(cue)

    def all_of(pattern, group, test):
        return F.when(text.isNull(), None).when(test, F.regexp_extract_all(text, F.lit(pattern), group)).otherwise(
            F.array().cast("array<string>"))

    names = F.filter(all_of(NAME_J, 1, hint), lambda x: ~x.isin(*PLACEHOLDER_NAMES))
    return names, all_of(PHONE_J, 0, text.rlike(PHONE_HINT)), all_of(ADDRESS_J, 0, text.rlike(ADDRESS_HINT))


def with_pii(df, text_col: str = "text"):
    """Adds ``has_pii``, ``pii_types``, ``pii_details``; each pattern is matched once per row
    (the match arrays are materialised in one projection, then combined in the next)."""
    names, phones, addrs = pii_matches(F.col(text_col))
    m = df.withColumn("_n", names).withColumn("_ph", phones).withColumn("_ad", addrs)
    types = F.filter(F.array(
        F.when(F.size("_n") > 0, F.lit("name")),
        F.when(F.size("_ph") > 0, F.lit("phone")),
        F.when(F.size("_ad") > 0, F.lit("address"))), lambda x: x.isNotNull())
    m = m.withColumn("pii_types", types) \
         .withColumn("pii_details", F.array_join(F.concat("_n", "_ph", "_ad"), "; "))
    return m.withColumn("has_pii", F.size("pii_types") > 0).drop("_n", "_ph", "_ad")
