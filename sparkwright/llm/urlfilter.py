"""URL filters: rules by host and path, and a listed-hosts test by a cascade of Bloom filters, in DataFrame functions only.

A key is a host or a parent domain of it; a page is listed if any key of its host is. The cascade is built against every
key that the pages have: level 1 is a Bloom filter of the listed keys; level 2 of those other keys of the corpus that
level 1 wrongly takes; level 3 of the listed keys that level 2 wrongly takes; and so on, until a level takes none wrongly.
A key of the corpus is listed if and only if the first level that does not take it has an even number. The test is exact
for the corpus and costs a few bit tests a row; there is no join, and no filter is larger than its keys' number asks.

Level 1's false positive rate is set so that level 2 has about as many keys as level 1 (listed over others, over the root
of 2), later ones at 1/2, and those of at most `FEW` keys so that most likely none follows: some 1.44 log2(others / listed)
+ 5 bits for each listed key in all. Filters go with the plan as constants, one for each level. Where all would have more
than `max_bits` bits, keys are dealt into shards by a hash, each with its own cascade, and the pages pass one shard after
another: what the driver and a task hold stays below max_bits or so, and longer lists cost more passes, but no join.

Cases: a null url, or one without "://", has the empty host and path, fits no rule and is listed only if the empty key is;
urls may be of any length; repeated rows are judged alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.shared import check_columns, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first "://" up to the next of / ? #, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to the next of ? #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, host, path) that fits, as a string, and its verdict; null if none does. Rules are few."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


class Level:
    """A Bloom filter: `bits` bits in 64-bit words, `hashes` bit tests for a key."""

    def __init__(self, number: int, keys: int, rate: float):
        self.number, self.hashes = number, max(1, round(-math.log2(rate)))
        self.bits = 64 * max(1, math.ceil(keys * 1.4427 * -math.log2(rate) / 64))
        self.words: list[int] = []

    def places(self, key: Column) -> list[Column]:
        """The bits for a key: two hashes, combined."""
        a, b = F.xxhash64(F.lit(2 * self.number), key), F.xxhash64(F.lit(2 * self.number + 1), key)
        return [F.pmod(F.pmod(a, F.lit(self.bits)) + i * F.pmod(b, F.lit(self.bits)), F.lit(self.bits)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Level:
        """Set the bits of all keys. Each task sends no more rows than the filter has words, and so does the whole."""
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        t = at.groupBy((F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
        self.words = [0] * (self.bits // 64)
        for word, bits in zip(t.column("word").to_pylist(), t.column("bits").to_pylist(), strict=True):
            self.words[word] = bits
        return self

    def takes(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # a constant once optimised

        def tests(w: Column) -> Column:
            out = F.lit(True)
            for p in self.places(key):
                out &= F.getbit(F.element_at(w, (p / 64).cast("int") + 1), (p % 64).cast("int")) == 1
            return out

        return F.exists(F.array(words), tests)  # the constant stands once in the plan, whatever the number of tests


#: From so many keys on, a level is made so exact that most likely none follows it.
FEW = 64


def cascade(both: DataFrame) -> list[Level]:
    """Levels that tell the listed keys from the others in both (key, hit: 1 or 0)."""
    counts = {r["hit"]: r["count"] for r in both.groupBy("hit").count().collect()}
    sizes = [counts.get(1, 0), counts.get(0, 0)]
    sides, levels = [both.filter("hit = 1").select("key"), both.filter("hit = 0").select("key")], []
    rate = min(0.5, sizes[0] / (math.sqrt(2) * max(sizes[1], 1)))
    while sizes[0]:
        if sizes[0] <= FEW and levels:
            rate = min(0.5, 1 / (16 * sizes[1]))
        levels.append(level := Level(len(levels) + 1, sizes[0], rate).fill(sides[0]))
        sides = [cut(sides[1].filter(level.takes(F.col("key")))), sides[0]]
        sizes, rate = [sides[0].count(), sizes[0]], 0.5
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level without it has an even number, or all have it and their number is odd."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.takes(key), out).otherwise(F.lit(level.number % 2 == 0))
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", max_bits: int = 1 << 25) -> DataFrame:
    """Per page: page_id, host, path, rule, and verdict: the rule's, else block if a key of the host is listed, else allow.

    listed: a table of keys (column `key`), hosts in lower case; nulls and repeated ones are ignored.
    """
    check_columns(pages, [page_id, url])
    check_columns(listed, ["key"])
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    universe = rows.select("host").distinct().select(F.explode(keys_of(F.col("host"))).alias("key")).distinct()
    listed = listed.filter("key is not null").select("key", F.lit(1).alias("hit"))
    both = cut(universe.select("key", F.lit(0).alias("hit")).unionByName(listed).groupBy("key").agg(F.max("hit").alias("hit")))
    n, others = both.agg(F.sum("hit"), F.sum(1 - F.col("hit"))).first()
    shards = math.ceil((n or 0) * (1.4427 * max(1.0, math.log2(max((others or 0) / max(n or 0, 1), 1))) + 6) / max_bits)

    def of_shard(key: Column, k: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards)) == k if shards > 1 else F.lit(True)

    def listed_in(levels: list[Level], k: int) -> Column:
        return F.exists(keys_of(F.col("host")), lambda key: of_shard(key, k) & member(key, levels))

    hit = F.lit(False)
    for k in range(shards):
        test = listed_in(cascade(both.filter(of_shard(F.col("key"), k))), k)
        rows, hit = (cut(rows.withColumn("hit", hit | test)), F.col("hit")) if shards > 1 else (rows, test)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(hit, "block").otherwise("allow")).alias("verdict"))
