"""URL rules by a cascade of Bloom filters, in DataFrame functions alone."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path from there
    up to ? or #. Both are empty where the url is null or has no ://."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys that could fit: each suffix of the host at a dot, followed by each start of the path
    whose length some rule has; longest first, of equal length the one with the longer host."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    starts = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda n: F.struct((F.length(s) + n).alias("n"), F.length(s).alias("h"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sort_array(pairs, asc=False), lambda p: p["key"]))


class Bloom:
    """A filter of `bits` bits as an array literal of 64-bit words; it is as large as its keys, not as the corpus."""

    def __init__(self, keys: DataFrame, level: int, bits_per_key: int, hashes: int, max_bits: int):
        n = keys.count()
        self.bits, self.level, self.hashes, self.keys = max(64, 64 * math.ceil(n * bits_per_key / 64)), level, hashes, n
        if self.bits > max_bits:
            raise ValueError(f"a level needs {self.bits} bits; the bound is {max_bits}")
        words = keys.select(F.explode(self._places(F.col("key"))).alias("place"))
        words = words.groupBy((F.col("place") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("mask"))
        self.words = [0] * (self.bits // 64)
        for row in words.collect():  # a row for each word of the filter: bits / 64 at most
            self.words[row["word"]] = row["mask"]

    def _places(self, key: Column) -> Column:
        a = F.pmod(F.xxhash64(key, F.lit(2 * self.level)), F.lit(self.bits))
        b = F.pmod(F.xxhash64(key, F.lit(2 * self.level + 1)), F.lit(self.bits - 1)) + 1
        return F.array(*[F.pmod(a + b * j, F.lit(self.bits)) for j in range(self.hashes)])

    def has(self, key: Column) -> Column:
        words = F.lit(self.words).cast("array<long>")
        return F.forall(self._places(key), lambda p: F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1)


def cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 12, hashes: int = 5, max_bits: int = 1 << 24) -> list[Bloom]:
    """Filters that together are exact on `listed` and on all of `universe` (both: a column key).

    Level 0 holds the listed keys, level 1 the universe's keys that pass level 0 wrongly, level 2 the
    listed keys that pass level 1 wrongly, and so on until nothing passes wrongly."""
    levels = [Bloom(listed, 0, bits_per_key, hashes, max_bits)]
    inside = listed
    wrong = universe.filter(levels[0].has(F.col("key"))).distinct()
    outside = common.store(wrong.join(listed, "key", "left_anti"), "passed")
    while True:
        inside, outside = outside, inside  # the keys to hold now, and those that must not pass
        if inside.isEmpty():
            return levels
        levels.append(Bloom(inside, len(levels), bits_per_key, hashes, max_bits))
        outside = common.store(outside.filter(levels[-1].has(F.col("key"))), "passed")


def member(levels: list[Bloom], key: Column) -> Column:
    """Whether a key of the universe is listed: exact, without a join."""
    return reduce(lambda inner, level: level.has(key) & ~inner if inner is not None else level.has(key), reversed(levels), None)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_key: int = 12, hashes: int = 5, max_bits: int = 1 << 24) -> DataFrame:
    """id_col, host, path, rule, verdict for each row of pages.

    rules: host, path, action (allow or block). A rule fits its host and every subdomain where the
    path starts with the rule's; the longest (host and path together) wins, of equal ones that with the
    longer host; no rule: null and `default`. Of a rule given twice with both actions, block wins.
    Two cascades, of the allowed and of the blocked keys, are built over every key that the whole
    table could ask for. Null, empty or malformed urls have host and path empty and no rule; repeated
    rows are judged alike; tables may be empty; other columns are ignored.
    """
    keys = rules.select(F.concat(F.translate("host", _UPPER, _LOWER), F.coalesce("path", F.lit(""))).alias("key"), F.length(F.coalesce("path", F.lit(""))).alias("n"), "action").filter("key is not null")
    lengths = sorted(r["n"] for r in keys.select("n").distinct().collect())  # at most the longest rule's length
    host, path = split_url(F.col(url_col))
    asked = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = asked.select(F.explode("keys").alias("key"))
    blocked = keys.filter("action = 'block'").select("key").distinct()
    allowed = keys.filter("action = 'allow'").select("key").distinct().join(blocked, "key", "left_anti")
    filters = {"allow": cascade(allowed, universe, bits_per_key, hashes, max_bits), "block": cascade(blocked, universe, bits_per_key, hashes, max_bits)}
    hit = F.get(F.filter("keys", lambda k: member(filters["allow"], k) | member(filters["block"], k)), F.lit(0))
    out = asked.withColumn("rule", hit)
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(member(filters["block"], F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col(id_col), "host", "path", "rule", verdict.alias("verdict"))
