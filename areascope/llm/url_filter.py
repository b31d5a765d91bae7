"""URL filter: ordered rules, then exact membership in a list by a cascade of Bloom filters.

Level 0 holds the listed keys. The keys of the corpus that it takes for listed by mistake go into
level 1, the listed keys that level 1 takes for mistakes into level 2, and so on until no mistake is
left. Over the keys it was built from the cascade is exact, and a lookup needs no join: levels are
literals of the plan, a few bits per listed key.

The literals are bounded: if all levels together would exceed `max_bytes`, keys are cut into shards
by a hash, every shard gets its own cascade, and its pages are judged and written before the next
shard's levels are built. The pages are then read once per shard.

Defined results: a missing url, or one without ://, has empty host and path and no rule; an empty or
missing key is not listed. Repeated pages get equal verdicts, urls of any length are read whole. No
pages give no rows, an empty list blocks nothing. Input columns named host, path, listed, rule or
verdict are replaced; all others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.llm.text import lower_az
from areascope.session import materialise

MAX_BYTES = 4 << 20
SHARD_SALT = 1 << 20
HALF = (1 << 31) - 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = lower_az(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | F.endswith(host, F.lit("." + self.host))
        return inside & F.startswith(path, F.lit(self.path))


def longest_rule(rules: Sequence[Rule], host: Column, path: Column, what: str) -> Column:
    """`what` of the longest rule that fits, else null; of equal length the longer host wins."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        out = F.when(r.fits(host, path), F.lit(getattr(r, what))).otherwise(out)
    return out


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    salt: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        # split and cast are folded: the executed plan has one array literal
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for at in _places(key, self.bits, self.hashes, self.salt):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            out &= F.getbit(word, (at % 64).cast("int")) == 1
        return out


def _places(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    a = F.xxhash64(F.lit(salt), key).bitwiseAND(F.lit(HALF))
    b = F.xxhash64(F.lit(~salt), key).bitwiseAND(F.lit(HALF))
    return [F.pmod(a + b * i, F.lit(bits).cast("long")) for i in range(hashes)]


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits, a multiple of 64, and hashes of a filter with n keys and this rate of mistakes."""
    per_key = math.log2(1 / rate)
    bits = max(64, math.ceil(n * per_key / math.log(2) / 64) * 64)
    return bits, max(1, round(per_key))


def _level(keys: DataFrame, bits: int, hashes: int, salt: int) -> Level:
    places = F.explode(F.array(*_places(F.col("key"), bits, hashes, salt))).alias("at")
    words = (
        keys.select(places)
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    )
    filled = [0] * (bits // 64)
    for row in words.collect():  # at most bits / 64 rows, bounded by the shards
        filled[row["word"]] = row["bits"]
    return Level(bits, hashes, salt, tuple(filled))


def _first_rate(n: int, others: int) -> float:
    """The first level's rate of mistakes: it balances that level against those that follow."""
    return min(0.5, math.sqrt(0.5) * n / others) if n and others else 0.5


def cascade_bytes(n: int, others: int) -> int:
    """Expected size of all levels; those behind the first halve what is left of either side."""
    rate = _first_rate(n, others)
    return math.ceil((n * (math.log2(1 / rate) + 1) + 2 * others * rate) / math.log(2) / 8)


def build_cascade(keys: DataFrame) -> list[Level]:
    """Levels over (key, listed), distinct keys."""
    keys = materialise(keys)
    inside, outside = keys.where("listed"), keys.where("NOT listed")
    n = inside.count()
    levels: list[Level] = []
    rate = _first_rate(n, outside.count())
    while n:
        bits, hashes = _shape(n, rate)
        levels.append(_level(inside, bits, hashes, len(levels)))
        mistakes = materialise(outside.where(levels[-1].holds(F.col("key"))))
        inside, outside, n, rate = mistakes, inside, mistakes.count(), 0.5
    return levels


def is_listed(levels: Sequence[Level], key: Column) -> Column:
    """Walks the levels: the first that doesn't hold the key decides by its parity."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def mark_listed(df: DataFrame, key: str, keys: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add `listed`: whether `keys` (key, listed), the distinct keys of `df`, lists the row's key."""
    keys = materialise(keys)
    size = keys.agg(F.count_if("listed").alias("n"), F.count_if(~F.col("listed")).alias("others")).first()
    shards = max(1, math.ceil(cascade_bytes(size["n"], size["others"]) / max_bytes))
    if shards == 1:
        return df.withColumn("listed", is_listed(build_cascade(keys), F.col(key)))

    def shard(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(SHARD_SALT), c), F.lit(shards))

    parts = []
    for i in range(shards):
        levels = build_cascade(keys.where(shard("key") == i))
        part = df.where(shard(key) == i).withColumn("listed", is_listed(levels, F.col(key)))
        parts.append(materialise(part))
    return reduce(DataFrame.unionByName, parts)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], blocked_words: Sequence[str] = (),
    blocked_hosts: DataFrame | None = None, max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Pages with host, path, rule, listed and verdict.

    The list: the hosts of the corpus that have one of `blocked_words` between dots or hyphens, and
    those that are in the first column of `blocked_hosts`, a table of any size, A-Z lower-cased.
    """
    host, path = host_and_path(F.col("url"))
    judged = pages.withColumns({"host": host, "path": path})
    word = r"(^|[.-])(" + "|".join(blocked_words) + r")([.-]|$)"
    by_word = F.col("key").rlike(word) if blocked_words else F.lit(False)
    keys = judged.select(F.col("host").alias("key")).distinct()
    if blocked_hosts is not None:
        named = blocked_hosts.select(lower_az(F.col(blocked_hosts.columns[0])).alias("key"))
        both = keys.withColumn("seen", F.lit(True)).unionByName(named.withColumn("seen", F.lit(False)))
        keys = both.groupBy("key").agg(F.bool_or("seen").alias("seen"), F.bool_or(~F.col("seen")).alias("named"))
        keys, by_word = keys.where("seen"), by_word | F.col("named")
    keys = keys.select("key", (by_word & (F.col("key") != "")).alias("listed"))
    judged = mark_listed(judged, "host", keys, max_bytes)
    by_rule = longest_rule(rules, F.col("host"), F.col("path"), "verdict")
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.withColumns(
        {
            "rule": longest_rule(rules, F.col("host"), F.col("path"), "text"),
            "verdict": F.coalesce(by_rule, by_list),
        }
    )
