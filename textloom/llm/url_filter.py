"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8                    # short hash: the first 32 bits of the SHA-256 digest
DEFAULT_VERDICT = "allow"

#: The query's rules (fixed by its contract): host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def _folder(path: Column) -> Column:
    """The path through its last slash: the part of a rule that the equi-join can carry."""
    return F.regexp_extract(path, r"(?s)^.*/", 0)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, url``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all sub-domains if the
    URL's path starts with the rule's path. The longest rule (host and path together) wins; among equally long
    ones the longer host, then ``allow``, then the alphabetical order. Rules with an empty host are ignored.

    Every URL is expanded into host suffixes and path prefixes ending in a slash, only for the depths that the
    rules have (a deeper expression can equal no rule). The expressions are joined with the rules on 32 hash bits
    alone; the full digest and the rest of the rule's path are confirmed on the joined rows, so a hash collision changes nothing.

    Nulls: a null URL, or one without ``://``, has an empty host and path and the default verdict; a null
    ``page_id`` is a value like any other. Repeated rows stay repeated. An empty table gives an empty result.
    Other columns of ``pages`` and ``rules`` are not read, whatever their names.
    """
    r = (rules.select(F.translate("host", UPPER, LOWER).alias("r_host"),
                      F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
         .where("r_host != '' AND r_verdict IS NOT NULL").distinct()
         .withColumn("r_digest", _digest(F.col("r_host"), _folder(F.col("r_path"))))
         .withColumn("short", F.substring("r_digest", 1, PREFIX_HEX)))
    # two numbers: no expression deeper than the deepest rule can match
    labels, depth = r.agg(F.max(F.size(F.split("r_host", r"\."))),
                          F.max(F.length(F.regexp_replace("r_path", "[^/]", "")))).first()

    p = (pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("copies"))
         .withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url"))))
    if labels is None:
        hits = p.withColumn("best", F.lit(None).cast("struct<rule:string,r_verdict:string>"))
    else:
        parts = F.split("host", r"\.")
        suffixes = F.transform(
            F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
            lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
        cuts = F.split("path", "/")
        folders = F.transform(
            F.sequence(F.lit(0), F.least(F.size(cuts) - 1, F.lit(depth))),
            lambda k: F.when(k == 0, F.lit("")).otherwise(
                F.concat(F.array_join(F.slice(cuts, 1, k), "/"), F.lit("/"))))
        x = (p.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(folders))
             .withColumn("digest", _digest(F.col("suffix"), F.col("folder"))))
        x = x.withColumn("x_short", F.substring("digest", 1, PREFIX_HEX))
        confirmed = (F.col("digest") == F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path"))
        rule = F.concat("r_host", "r_path")
        order = F.struct(F.length(rule), F.length("r_host"), (F.col("r_verdict") == "allow"), rule)
        # the pages keep their partitioning by (page_id, url): no second shuffle after a broadcast of the rules
        hits = (x.join(r, F.col("x_short") == F.col("short"), "left").groupBy("page_id", "url")
                .agg(F.max_by(F.struct(rule.alias("rule"), "r_verdict"),
                              F.when(confirmed, order)).alias("best"),
                     F.first("copies").alias("copies"), F.first("host").alias("host"),
                     F.first("path").alias("path")))
    return (hits.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"), "url"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS t(host, path, verdict)")
    return filter_urls(read_table(spark, sf_dir, "pages"), rules)


OP1_SQL = """
WITH cut AS (
  SELECT page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
judged AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')
                   THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')
                   THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict, url
FROM judged
"""
