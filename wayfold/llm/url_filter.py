"""URL filtering: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is (host, path, verdict).  It fits a url if the url's host is the rule's host or one of its
subdomains and the url's path starts with the rule's path.  The longest fitting rule wins (host and path
characters together, then the smaller rule text); urls that no rule fits get ``default``.

Everything is DataFrame functions.  Each url tests its host suffixes and path prefixes against the filter
inside one row (higher-order functions, no explode); only keys that the filter passes are exploded and
joined with the rules, so the join sees the possible hits of distinct (host, path) pairs.  Its result goes back to the
pages with possible hits alone; all other pages, also those without a url, take no part in any shuffle.

Defined cases: null url, or no ``://``: empty host and path, default verdict.  Repeated rows keep their
count.  An empty rule table gives every url the default.  Extra columns pass through; columns that this
operator adds replace columns of the same name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.names import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The filter is a literal of at most this many 64-bit blocks (1 MiB), whatever the number of rules;
#: more rules raise the rate of false positives, which the join removes.
MAX_BLOCKS = 1 << 17
SALTS = 16


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and its four bits in that block."""
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for shift in (32, 38, 44, 50):
        bit = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(h, F.lit(blocks)).cast("int"), mask


def build_filter(rules: DataFrame, bits_per_key: int = 16) -> list[int]:
    """64-bit blocks of the filter over the rules' keys; at most MAX_BLOCKS words reach the driver."""
    n = rules.count()
    blocks = 1
    while blocks * 64 < n * bits_per_key and blocks < MAX_BLOCKS:
        blocks *= 2
    block, mask = _bits(_key(F.col("rule_host"), F.col("rule_path")), blocks)
    words = [0] * blocks
    for row in rules.groupBy(block.alias("b")).agg(F.bit_or(mask).alias("m")).collect():
        words[row.b] = row.m
    return words


def _host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules``: host, path, verdict.  Of rules with equal host and path the smallest verdict text holds.
    """
    listed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.min("verdict").alias("rule_verdict"))
    )
    words = build_filter(listed)
    lengths = sorted(r[0] for r in listed.select(F.length("rule_path")).distinct().collect())
    page = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if not lengths:
        return page.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # One literal text, folded to an array when the plan is made; a literal for each word would take minutes to build.
    blocks = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    prefixes = F.filter(
        F.transform(F.lit(lengths), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))),
        lambda p: p.isNotNull(),
    )
    pairs = F.flatten(F.transform(_host_suffixes(F.col("host")), lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("h"), p.alias("p")))))

    def might_hold(pair: Column) -> Column:
        block, mask = _bits(_key(pair["h"], pair["p"]), len(words))
        return F.get(blocks, block).bitwiseAND(mask) == mask

    # Of the pages themselves only possible hits meet the join; those that the filter clears pass by.
    some, won, salt = unused(page.columns, "__possible", "__best", "__salt")
    kept = [c for c in page.columns if c not in ("rule", "verdict")]
    page = page.withColumn(some, F.filter(pairs, might_hold))
    hits, clear = page.where(F.size(some) > 0), page.where(F.size(some) == 0)
    possible = (
        hits.select("host", "path", some).dropDuplicates(["host", "path"])
        .select("host", "path", F.explode(some).alias("k"))
        .select("host", "path", F.col("k.h").alias("rule_host"), F.col("k.p").alias("rule_path"))
    )
    text = F.concat("rule_host", "rule_path")
    best = (
        possible.join(listed, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length(text)).alias("n"), text.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias(won))
    )
    # One url may be behind a third of all rows, so its rows are dealt over SALTS partitions.
    best = best.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = hits.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(best, ["host", "path", salt], "left")
    judged = met.select(*kept, F.col(won)["rule"].alias("rule"), F.coalesce(F.col(won)["verdict"], F.lit(default)).alias("verdict"))
    return judged.union(clear.select(*kept, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


#: The rules of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path and verdict of every page under RULES; null urls have neither host nor path and are allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path,
    (SELECT h || p FROM rules WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p) ORDER BY length(h || p) DESC, h || p LIMIT 1) AS rule,
    coalesce((SELECT v FROM rules WHERE (host = h OR suffix(host, '.' || h)) AND prefix(path, p) ORDER BY length(h || p) DESC, h || p LIMIT 1), 'allow') AS verdict
FROM u
"""
