"""URL filters by hashed expressions, in DataFrame functions only.

A URL is expanded into host suffixes (at label borders) and path prefixes (of the lengths that rules have). Each
expression is hashed; its first 32 bits are joined with the rules' and the full SHA-256 then confirms the hit. Of the
rules that hit, the longest wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkward.llm import base

#: (host, path, verdict) of the production rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hex digits of the short hash prefix.
SHORT = 8


def rules_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """Rules as a table (host, path, verdict)."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("host", "path", "verdict")))
    rows = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("host", "path", "verdict"), strict=True))) for r in rules))
    return spark.range(1).select(F.inline(rows))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(urls: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """(url, expression) for every host suffix of up to so many labels and every path prefix of a length in lengths."""
    parts = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(labels))), lambda i: F.array_join(F.slice("parts", -i, i), "."))
    sizes = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    some = urls.withColumn("parts", parts).select("url", "path", suffixes.alias("suffixes"), sizes.alias("sizes"))
    made = F.flatten(F.transform("suffixes", lambda s: F.transform("sizes", lambda n: F.concat(s, F.substring("path", F.lit(1), n)))))
    return some.select("url", F.explode(F.array_distinct(made)).alias("expression"))


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The columns in keep, then host, path, rule (null where none fits) and verdict, a row for each row of pages.

    Null or malformed URLs have empty host and path and get the default. The longest rule (host and path together)
    wins; of equally long ones the longer host, then block before allow. Each distinct URL is judged once. Those that a
    rule fits are a written table that is joined back to the rows by URL: a small one is broadcast by its size, and else
    AQE can split a URL that very many rows share, since both sides are exchanges of their own. Null URLs take no part
    in any join. Only the distinct path lengths of the rules and their largest number of labels, a row of bounded size,
    go to the driver.
    """
    spark = pages.sparkSession
    shape = rules.agg(F.collect_set(F.length("path")).alias("n"), F.max(F.size(F.split("host", r"\."))).alias("labels")).first()
    lengths, labels = sorted(shape["n"]) or [0], shape["labels"] or 1
    digest = F.sha2(F.col("expression"), 256)
    ruled = rules.select("host", "path", "verdict", F.concat("host", "path").alias("rule"), F.sha2(F.concat("host", "path"), 256).alias("digest"))
    ruled = ruled.select(F.substring("digest", 1, SHORT).alias("short"), "digest", F.struct(F.length("rule").alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b"), "rule", "verdict").alias("hit"))
    rows = pages.select(*keep, F.col(url_col).cast("string").alias("__url"))
    urls = rows.where("__url is not null").select(F.col("__url").alias("url")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    made = expressions(urls, labels, lengths).select("url", digest.alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    hits = made.join(ruled, "short").where(F.col("full") == F.col("digest")).groupBy("url").agg(F.max("hit").alias("hit"))
    hits, _ = base.written(spark, hits.select(F.col("url").alias("__url"), "hit.rule", "hit.verdict").withColumnsRenamed({"rule": "__rule", "verdict": "__verdict"}), "url-hits")
    none = F.lit(None).cast("string")
    nulls = rows.where("__url is null").withColumns({"__rule": none, "__verdict": none})
    found = rows.where("__url is not null").join(hits, "__url", "left").unionByName(nulls)
    url = F.col("__url")
    return found.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(base.table(spark, sf_dir, "pages"), rules_table(spark))


OP4_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN (SELECT DISTINCT * FROM m) m USING (page_id, host, path)
"""
