"""URL filters (operator 5), in DataFrame operations only.

Listed canonical URLs go into a blocked Bloom filter: a hash picks a block of eight 64-bit words
and one bit in each. The filter passes possible hits, and an exact join with the list removes the
false ones. Rules on hosts and paths override the list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.shared import written

WORDS = 8
BITS_PER_URL = 16
TRACKING = "^(utm_[^=]*|ref)(=|$)"
#: Fixed values: (action, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labels of hosts that the list is drawn from.
LISTED = ("adult", "bets", "casino", "spam")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without its last slash, sorted query without tracking."""
    query = F.regexp_extract(after_scheme(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    base = F.concat(F.regexp_replace(host(url), "^www\\.", ""),
                    F.regexp_replace(path(url), "/$", ""))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(
        base)


def matching_rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits the host or a parent of it and the path."""
    rule = action = F.lit(None).cast("string")
    # the longer rules are asked first
    for act, domain, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_ == domain) | host_.endswith("." + domain)) & path_.startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bit(key: Column, word: int) -> Column:
    return F.call_function(
        "shiftleft", F.lit(1).cast("long"),
        F.pmod(F.shiftright(F.xxhash64(key, F.lit("bloom")), 6 * word), F.lit(64)).cast("int"))


def bloom_filter(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the bits of the keys, by block."""
    bits = keys.select(block_of(F.col(column), blocks).alias("block"),
                       *[bit(F.col(column), k).alias(f"w{k}") for k in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def listed_hits(rows: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """``rows`` with ``listed`` boolean: whether ``column`` is in the one column of ``listed``.

    The list and its filter are written, so Spark knows their sizes and broadcasts either only
    below its own threshold; beyond it both joins are shuffled by block and by key.
    """
    keys = written(listed.select(F.col(listed.columns[0]).alias("_listed")).where(
        "_listed is not null").distinct(), "listed")
    blocks = max(1, -(-keys.count() * BITS_PER_URL // (64 * WORDS)))
    bloom = written(bloom_filter(keys, "_listed", blocks), "bloom")
    probe = rows.withColumn("block", block_of(F.col(column), blocks)).join(bloom, "block", "left")
    possible = reduce(Column.__and__, [
        F.coalesce(F.col(f"w{k}").bitwiseAND(bit(F.col(column), k)) != 0, F.lit(False))
        for k in range(WORDS)])
    asked = probe.withColumn("_possible", possible).drop("block", *[f"w{k}" for k in range(WORDS)])
    # only possible hits enter the exact join; all others would meet there under one key
    hits = (asked.where("_possible").join(keys, F.col(column) == F.col("_listed"), "left")
            .withColumn("listed", F.col("_listed").isNotNull()).drop("_listed"))
    rest = asked.where("NOT _possible").withColumn("listed", F.lit(False))
    return hits.unionByName(rest).drop("_possible")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed, canonical for every row of ``pages``.

    The longest fitting rule decides; without one, a listed canonical URL is blocked and any other
    allowed. A null url or one without ``://`` has an empty host and path, fits no rule and is
    listed only if the empty URL is. ``listed`` has one column of canonical URLs; nulls in it
    count for nothing and repeats once. Repeated and null ids are kept; an empty table gives no
    rows; other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"),
                        path(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.select("page_id", *[F.coalesce(c, F.lit("")).alias(c)
                                    for c in ("host", "path", "canonical")])
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    hits = listed_hits(rows, "canonical", listed)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return hits.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"),
                       "listed", "canonical")


def listed_urls(pages: DataFrame, labels=LISTED) -> DataFrame:
    """Canonical URLs of the pages whose host names a listed label."""
    named = host(F.col("url")).rlike("(^|[.-])(" + "|".join(labels) + ")([.-]|$)")
    return pages.where(named).select(canonical(F.col("url")).alias("url"))
