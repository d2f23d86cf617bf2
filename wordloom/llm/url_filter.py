"""URL filters with a Bloom filter cascade, in DataFrame functions only.

Rules on host and path are tested first, the longest that fits wins. Other
URLs are blocked if their host or a parent domain is on a list of domains.
Membership of a domain is exact without a join: a cascade of Bloom filters is
built over the complete universe of keys, that is, every host and parent
domain that occurs in the corpus. Level 0 holds the listed keys; level 1 the
keys of the universe that level 0 takes for listed though they are not; level
2 the listed keys that level 1 takes for those; and so on until a level lets
nothing wrong through. A key is listed if the number of the first level that
does not hold it is odd.

Filters are arrays of 64-bit words, constants of the probing plan, so scanning
URLs needs no join and no shuffle. Their size follows the list, not the
corpus: :data:`MAX_BITS` per level is the bound. A longer list is split by key
hash into as many cascades as keep each level under it, and past
:data:`MAX_CASCADES` of those (about 25 million keys) :func:`blocked` falls
back to a semi join on the keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import remove, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MAX_RULES = 200
FIRST_RATE, NEXT_RATE = 0.05, 0.5
MAX_BITS = 1 << 22
MAX_CASCADES = 40
MIN_BITS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end. Both are
    empty for null and for a URL without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; list domains instead")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, tail = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + tail)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def domains(host: Column) -> Column:
    """The host and its parent domains; none for the empty host."""
    n_labels = F.size(F.split(host, r"\."))
    return F.filter(F.transform(F.sequence(F.lit(1), n_labels), lambda n: F.call_function("substring_index", host, F.lit("."), -n)),
                    lambda d: d != "")


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` is a power of two, ``words`` its 64-bit words."""
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")   # folded to one constant
        hit = F.lit(True)
        for p in positions(key, self.bits, self.hashes, self.seed):
            hit = hit & (F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return hit


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(seed * 64 + j)).bitwiseAND(F.lit(bits - 1)) for j in range(hashes)]


def make_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The filter of ``n`` keys (column ``key``) with about ``rate`` false
    positives. Its words are built by one aggregate; their number is bounded
    by the bits."""
    per_key = -math.log(rate) / math.log(2) ** 2
    bits = max(MIN_BITS, 1 << math.ceil(math.log2(max(1, n) * per_key)))
    hashes = max(1, round(bits / max(1, n) * math.log(2))) if n * 8 > bits else max(1, round(-math.log2(rate)))
    at = F.explode(F.array(*positions(F.col("key"), bits, hashes, seed)))
    words = dict(keys.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int")))).collect())
    return Level(bits, hashes, seed, tuple(words.get(w, 0) for w in range(bits // 64)))


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> list[Level]:
    """Levels for distinct keys ``listed`` over distinct keys ``universe``
    (each one column ``key``; the universe may or may not hold listed keys)."""
    spark: SparkSession = listed.sparkSession
    inside = written(spark, listed, "cascade-keys")        # what the next level must hold
    outside = universe.join(inside, "key", "left_anti")
    levels: list[Level] = []
    n = inside.count()
    spent = []
    while n:
        levels.append(make_level(inside, n, FIRST_RATE if not levels else NEXT_RATE, seed * 1000 + len(levels)))
        passed = written(spark, outside.filter(levels[-1].holds(F.col("key"))), "cascade-keys")
        spent.append(inside)
        inside, outside = passed, inside
        n = inside.count()
    for df in [*spent, inside]:
        remove(spark, df)
    return levels


def in_cascade(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe or the list is listed."""
    listed = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        listed = F.when(~levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(listed)
    return listed


def blocked(urls: DataFrame, host_col: str, listed: DataFrame) -> DataFrame:
    """``urls`` with ``listed``: whether ``host_col`` or a parent domain of it
    is among the keys of ``listed`` (one column of domains, any order,
    repeats and nulls allowed)."""
    spark = urls.sparkSession
    keys = written(spark, listed.toDF("key").filter("key is not null").distinct(), "listed-keys")
    hosts = urls.select(F.col(host_col).alias("h")).distinct()
    universe = written(spark, hosts.select(F.explode(domains(F.col("h"))).alias("key")).distinct(), "universe")
    per_key = -math.log(FIRST_RATE) / math.log(2) ** 2
    parts = max(1, math.ceil(keys.count() * per_key / MAX_BITS))
    if parts > MAX_CASCADES:
        bad = hosts.select("h", F.explode(domains(F.col("h"))).alias("key")).join(keys, "key", "left_semi") \
            .select(F.col("h").alias(host_col)).distinct().withColumn("listed", F.lit(True))
        return urls.join(bad, host_col, "left").fillna(False, ["listed"])
    of = lambda c: F.pmod(F.xxhash64(c, F.lit(-1)), F.lit(parts))
    cascades = [build_cascade(keys.filter(of(F.col("key")) == i), universe.filter(of(F.col("key")) == i), i)
                for i in range(parts)]
    remove(spark, keys)
    remove(spark, universe)

    def member(key: Column) -> Column:
        out = in_cascade(key, cascades[0])
        for i in range(1, parts):
            out = F.when(of(key) == i, in_cascade(key, cascades[i])).otherwise(out)
        return out
    return urls.withColumn("listed", F.exists(domains(F.col(host_col)), member))


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules=RULES) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row."""
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = blocked(parsed, "host", listed).select(
        "id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
    return out.withColumnRenamed("id", id_col)
