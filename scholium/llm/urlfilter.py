"""URL filter: domain rules, then a Bloom filter cascade over the corpus's own keys; built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Names of unwanted sites; each is listed below each of the domains.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{domain}" for name in LISTED_NAMES for domain in LISTED_DOMAINS)
#: Words of 64 bits in one table of a filter; a larger filter has several.
TABLE = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equally long ones the first; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, domain, prefix in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def suffixes(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(names)


class Level:
    """One Bloom filter: m bits, k hashes, the bits as signed 64-bit words in tables of TABLE words."""

    def __init__(self, number: int, m: int, k: int, words: dict[int, int]):
        self.number, self.m, self.k = number, m, k
        size = -(-m // 64)
        self.tables = [[words.get(i, 0) for i in range(at, min(at + TABLE, size))] for at in range(0, size, TABLE)]

    @staticmethod
    def positions(key: Column, number: int, m: int, k: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(number * 64 + i)), F.lit(m)) for i in range(k)]

    def holds(self, key: Column) -> Column:
        # Every table is folded into a literal of the plan, and so is the array of them.
        tables = F.array(*(F.split(F.lit(",".join(map(str, t))), ",").cast("array<bigint>") for t in self.tables))
        hit = F.lit(True)
        for p in self.positions(key, self.number, self.m, self.k):
            place = F.floor(p / 64)
            word = F.get(F.get(tables, F.floor(place / TABLE).cast("int")), (place % TABLE).cast("int"))
            hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0)
        return hit


class Cascade:
    """Levels in turn hold listed keys and the others that the levels so far took for listed."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def member(self, key: Column) -> Column:
        """Whether a key of the universe is listed; exact on the universe, of which no other key may be asked."""
        found = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            found = F.when(level.holds(key), found).otherwise(F.lit(level.number % 2 == 1))
        return found


def build_cascade(universe: DataFrame) -> Cascade:
    """universe(key, listed), keys distinct -> the cascade, however many levels and tables it takes.

    Only counts and the words of the filters reach the driver. All levels together have a few bits for each listed key that the
    universe has, 1.44 log2 of how many others there are to one; nothing there grows with the pages.
    """
    levels: list[Level] = []
    alive = universe
    while True:
        number = len(levels)
        own = F.col("listed") == F.lit(number % 2 == 0)
        n, others = alive.agg(F.count_if(own), F.count_if(~own)).first()
        if number and not n:  # nobody was taken for the other kind
            return Cascade(levels)
        rate = min(0.5, n * math.sqrt(0.5) / others) if not number and others else 0.5
        rate = max(rate, 1e-6)
        m = max(64, math.ceil(1.44 * max(n, 1) * math.log2(1 / rate)))
        k = max(1, round(math.log2(1 / rate)))
        set_bits = alive.where(own).select(F.explode(F.array(*Level.positions(F.col("key"), number, m, k))).alias("p"))
        words = set_bits.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
        levels.append(Level(number, m, k, {r["w"]: r["bits"] for r in words.collect()}))
        if not others:
            return Cascade(levels)
        alive = cut(alive.where(own | levels[-1].holds(F.col("key"))))


def url_filter(pages: DataFrame, listed: tuple[str, ...] | DataFrame = LISTED, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages(page_id, url, ...).

    The longest rule that fits host and path decides, of equally long ones the first; else a page is blocked if its host or a parent
    domain is listed, and allowed otherwise. listed is names, or a table with a column `host`; null names and blank ones list nothing. The
    cascade is built over all hosts and parent domains of the pages, so membership is exact and needs no join with the pages. A null url or one without `://` has
    empty host and path, fits no rule and is allowed; very long urls are parsed whole; repeated rows stay; no rows give no rows; other columns are ignored.
    """
    parsed = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    if isinstance(listed, DataFrame):
        names = listed.select(F.translate(F.trim("host"), UPPER, LOWER).alias("key"))
    else:
        names = pages.sparkSession.createDataFrame([(x.strip().lower(),) for x in listed if x], "key string")
    names = names.where("key <> ''").distinct().withColumn("listed", F.lit(True))
    keys = parsed.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    cascade = build_cascade(cut(keys.join(names, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    blocked = F.exists(suffixes(F.col("host")), cascade.member)
    return parsed.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"))
