"""Filters of URLs by listed canonical URLs: a blocked Bloom filter, then an exact hash join.

A rule lists a canonical URL, its host and the beginning of its path.  Every URL yields the keys
under which a rule that fits it could be listed: its host and the domains above it, each with the
beginnings of its path, for the lengths that occur in the list only.  The filter is a table of
512-bit blocks, one block and eight bits a key; keys that pass it are counted, and an exact join
with the list removes the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash128, pack, settle, unpack

#: Words of 64 bits in a block; each holds one bit of a key.
LANES = 8
#: Keys that a block is made for (32 bits a key), and the most blocks of a filter (16 MB of bits).
KEYS_A_BLOCK, MAX_BLOCKS = 16, 1 << 18
#: Most keys that count as hot, and the least number of candidates that such a key has.
HOT_KEYS, HOT_LEAST = 10_000, 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path).  The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; the path goes on up to ``?``, ``#`` or the end.  Null or no ``://``: both empty."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def _listed(rules: DataFrame) -> DataFrame:
    """The distinct rules as (key, size, host_size, path_size, verdict); of two verdicts block holds."""
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
    key = F.concat(host, F.coalesce("path", F.lit("")))
    named = rules.where("verdict IN ('allow', 'block')").select(key.alias("key"), F.char_length(host).alias("host_size"), "verdict").where("host_size > 0")
    # The host has no slash and a path begins with one, so a key tells both apart.
    one = named.groupBy("key", "host_size").agg(F.max("verdict").alias("verdict"))
    return one.withColumn("path_size", F.char_length("key") - F.col("host_size")).where("path_size = 0 OR substring(key, host_size + 1, 1) = '/'")


def _block_and_bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and, for each lane, its bit."""
    h1, h2 = hash128(key)
    return F.pmod(h1, F.lit(blocks)), [F.shiftrightunsigned(h2, 6 * lane).bitwiseAND(F.lit(63)).cast("int") for lane in range(LANES)]


def blocks_for(n_keys: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-n_keys // KEYS_A_BLOCK)))


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the filter's blocks that hold a key of ``keys`` (key)."""
    block, bits = _block_and_bits(F.col("key"), blocks)
    marks = keys.select(block.alias("block"), *[F.call_function("shiftleft", F.lit(1).cast("long"), b).alias(f"w{i}") for i, b in enumerate(bits)])
    return marks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)])


def may_hold(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``candidates`` (key, ...) whose key may be listed; none that is listed is lost.

    The filter has at most MAX_BLOCKS rows of 72 bytes, so it is broadcast.
    """
    block, bits = _block_and_bits(F.col("key"), blocks)
    tested = candidates.withColumn("block", block).join(F.broadcast(bloom), "block")
    is_set = [F.call_function("shiftrightunsigned", F.col(f"w{i}"), b).bitwiseAND(F.lit(1)) == 1 for i, b in enumerate(bits)]
    return tested.where(reduce(Column.__and__, is_set)).select(candidates.columns)


def candidate_keys(host: Column, path: Column, host_sizes: list[int], path_sizes: list[int]) -> Column:
    """The keys of all rules that could fit: each domain over the host of a listed length, with each
    beginning of the path of a listed length."""
    suits = lambda n: (F.char_length(host) == n) | ((F.char_length(host) > n) & (F.substring(host, F.char_length(host) - n, F.lit(1)) == "."))
    hosts = F.filter(F.array(*[F.lit(n) for n in host_sizes]), suits)
    paths = F.filter(F.array(*[F.lit(n) for n in path_sizes]), lambda n: F.char_length(path) >= n)
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(F.right(host, h), F.left(path, p)))))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule that holds, else null) and ``verdict``.

    ``rules`` has (host, path, verdict), verdict ``allow`` or ``block``; others, rules without a host
    and rules whose path begins with no slash fit nothing.  A rule fits its host and all
    subdomains if the URL's path starts with the rule's.  The longest host and path together
    wins; of equally long ones the longer host.  A rule listed with both verdicts
    blocks.  A URL that no rule lists gets ``default``.  Null and odd URLs have an empty host and
    path and get ``default``; rows equal in every column are judged alike and all stay; an empty
    table or list is no special case.  Columns named like the new ones are replaced.
    """
    names = pages.columns
    listed = settle(_listed(rules))
    about = listed.agg(F.count("*").alias("n"), F.collect_set("host_size").alias("hosts"), F.collect_set("path_size").alias("paths")).first()
    packed = pack(pages, key=True)
    host, path = split_url(F.col("row").getField(url_col))
    if not about.n:
        return unpack(packed, names, host=host, path=path, rule=F.lit(None).cast("string"), verdict=F.lit(default))
    blocks = blocks_for(about.n)
    urls = packed.select("k1", "k2", host.alias("host"), path.alias("path"))
    keys = F.explode(candidate_keys(F.col("host"), F.col("path"), sorted(about.hosts), sorted(about.paths)))
    hits = settle(may_hold(urls.select("k1", "k2", keys.alias("key")), bloom_filter(listed, blocks), blocks))
    # One row a key meets the list, however many URLs hold it.
    exact = settle(hits.groupBy("key").agg(F.count("*").alias("n")).join(listed, "key"))
    total = exact.agg(F.sum("n")).first()[0] or 0
    # Fewer than HOT_KEYS keys can hold that share of all hits each: they are broadcast; the rest meet by hash.
    is_hot = F.col("n") >= max(HOT_LEAST, total / HOT_KEYS)
    facts = F.struct((F.col("host_size") + F.col("path_size")).alias("size"), "host_size", F.col("key").alias("rule"), "verdict")
    hot = exact.where(is_hot).select("key", facts.alias("hot"))
    cold = exact.where(~is_hot).select(F.col("key").alias("at"), facts.alias("cold"))
    told = hits.join(F.broadcast(hot), "key", "left")
    at = F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.concat(F.lit("/"), F.col("k1").cast("string")))  # no key begins with a slash
    best = told.withColumn("at", at).join(cold, "at", "left").select("k1", "k2", F.coalesce("hot", "cold").alias("found")).where("found IS NOT NULL")
    best = settle(best.groupBy("k1", "k2").agg(F.max("found").alias("found")))
    judged = packed.join(best, ["k1", "k2"], "left")
    return unpack(judged, names, host=host, path=path, rule=F.col("found.rule"), verdict=F.coalesce("found.verdict", F.lit(default)))


#: The rules of ``op11_bloom_urls``.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_bloom_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


#: The same rows in DuckDB.
OP11_SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), urls AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), fits AS (
  SELECT u.n, max({'size': length(r.host || r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) AS best
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.n
)
SELECT u.page_id, u.host, u.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.n = u.n
"""
