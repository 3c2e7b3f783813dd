"""URL filters: host-suffix and path-prefix expressions, joined on short hashes, then confirmed.

Every rule ``(host, path, action)`` is an expression ``host + path``.  A URL expands into its host
suffixes (at dots) times the prefixes of its path that have the length of some rule's path, so any
rule that fits is among them.  Expressions and rules meet in an equi-join on the first four bytes
of their SHA-256; the full digests are then compared, and the longest expression wins.
The rules are broadcast only if they are counted to be few; beyond that the join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paraspark.llm.common import sized_broadcast, stored, table

BROADCAST_RULES = 200_000
DEFAULT_VERDICT = "allow"   # of urls that no rule fits

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """Up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """All host suffixes times the path prefixes of the given lengths, as an array of ``host\\0path`` pairs."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(
        prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))


def _keyed(df: DataFrame) -> DataFrame:
    digest = F.unhex(F.sha2(F.concat_ws("\n", "host", "path"), 256))
    return (df.withColumn("digest", digest)
            .withColumn("short", F.substring(F.col("digest"), 1, 4)))


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per input row: ``id, host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest
    ``host + path`` wins, of equal expressions ``block`` beats ``allow``.  Null urls and urls
    without ``://`` have an empty host and path; no rule fits them.  Repeated rows and ids are
    judged one by one.  Rules with a null or empty host are ignored, as are other columns of either
    input.  ``rule`` is null and ``verdict`` is ``default`` where nothing fits.
    """
    rules = (rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "action")
             .where("host <> '' AND action IS NOT NULL")
             .groupBy("host", "path").agg(F.max("action").alias("action")))
    shape = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    urls = df.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("url_host"),
                     url_path(F.col(url_col)).alias("url_path"))
    # urls that differ only in their path share most expressions: each distinct prefix is matched once
    heads = urls.withColumn("head", F.substring("url_path", 1, max(shape["lengths"] or [0])))
    distinct = heads.where("url_host <> ''").select("url_host", "head").distinct()
    expanded = distinct.select("url_host", "head", F.explode(
        expressions(F.col("url_host"), F.col("head"), list(shape["lengths"]))).alias("e"))
    expanded = _keyed(expanded.select("url_host", "head", "e.host", "e.path"))
    listed = sized_broadcast(_keyed(rules), shape["n"], BROADCAST_RULES)
    hits = (expanded.select("url_host", "head", "short", "digest")
            .join(listed.withColumnRenamed("digest", "rule_digest"), "short")
            .where(F.col("digest") == F.col("rule_digest")))
    rule = F.concat("host", "path")
    best = hits.groupBy("url_host", "head").agg(F.max(F.struct(
        F.length(rule).alias("n"), rule.alias("rule"), F.col("action"))).alias("best"))
    best = stored(best, "url-verdicts")     # distinct hosts and heads that a rule fits
    judged = heads.join(sized_broadcast(best, best.count(), BROADCAST_RULES), ["url_host", "head"], "left")
    return judged.select(F.col("id").alias(id_col), F.col("url_host").alias("host"),
                         F.col("url_path").alias("path"), F.col("best.rule").alias("rule"),
                         F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP6_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
     s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     rules(h, p, a) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
     j AS (SELECT s.*, h || p AS rule, a,
                  row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS rn
           FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(a, 'allow') AS verdict FROM j WHERE rn = 1
"""
