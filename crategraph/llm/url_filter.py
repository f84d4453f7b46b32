"""URL rules looked up in cascades of Bloom filters, in DataFrame functions only.

A rule is a host with a path prefix and a verdict. The keys a url could be listed under are its host's dot-suffixes joined
with the prefixes of its path that have some rule's path length. Over the distinct keys of the whole corpus (the *universe*)
a cascade is built for the allow rules and one for the block rules: level 1 encodes the listed keys, level 2 the keys of
the universe that pass level 1 falsely, level 3 the listed keys that pass level 2 falsely, and so on until nothing passes
falsely. Membership is then exact for every key of the corpus, and each url is judged by bit tests alone.

Size bound: with a first-level rate of listed/universe the levels need about 1.44 * log2(universe/listed) + 6 bits for each
listed key, whatever the corpus holds. The filters travel as literals of at most ``max_bits``; a level that needs more is split
by a hash of the key into several filters. Beyond ``max_filters`` of them (64 MB, some 20 million rules) the urls are matched by
an equi-join with the rules instead, with the same result: nothing of unbounded size travels with the tasks.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; repeated rows
return once each; with no rules all urls are allowed; a rule listed with both verdicts blocks.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crategraph.shared import settle

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, URL, 2)


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys a url could be listed under: array<struct<size, host_size, key>>; the largest listed one is the longest rule."""
    labels = F.split(host, r"\.")
    suffixes = F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    sizes = F.filter(F.array(*(F.lit(n) for n in path_lengths)), lambda n: n <= F.length(path))
    key = lambda s, n: F.struct((F.length(s) + n).alias("size"), F.length(s).alias("host_size"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key"))
    return F.coalesce(F.flatten(F.transform(suffixes, lambda s: F.transform(sizes, lambda n: key(s, n)))), F.array().cast("array<struct<size:int,host_size:int,key:string>>"))


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))


class TooLarge(ValueError):
    """A level would need more bits than may travel in a plan."""


class BloomLevel:
    """A Bloom filter, or several among which a hash of the key chooses: bits as byte strings, tested by SQL expressions."""

    def __init__(self, keys: DataFrame, count: int, rate: float, salt: int, max_bits: int, max_filters: int):
        bits = max(64, math.ceil(count * math.log2(1 / rate) * 1.4427))
        self.filters = -(-bits // max_bits)
        if self.filters > max_filters:
            raise TooLarge(f"{bits} bits")
        self.bits = 64 * math.ceil(bits / self.filters / 64)
        self.probes, self.salt = max(1, round(math.log2(1 / rate))), salt
        words = keys.select(self._filter(F.col("key")).alias("filter"), F.explode(F.array(*self._positions(F.col("key")))).alias("p"))
        words = words.groupBy("filter", F.floor(F.col("p") / 8).alias("byte")).agg(F.bit_or(_bit(F.col("p"))).alias("set"))
        data = [bytearray(self.bits // 8) for _ in range(self.filters)]
        for row in words.collect():  # at most bits / 8 rows
            data[row["filter"]][row["byte"]] = row["set"]
        self.data = [F.lit(bytes(d)) for d in data]

    def _filter(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-self.salt)), F.lit(self.filters)).cast("int")

    def _positions(self, key: Column) -> list[Column]:
        first, step = (F.pmod(F.xxhash64(key, F.lit(2 * self.salt + k)), F.lit(self.bits)) for k in range(2))
        return [F.pmod(first + k * step, F.lit(self.bits)) for k in range(self.probes)]

    def passes(self, key: Column) -> Column:
        data = self.data[0] if self.filters == 1 else F.get(F.array(*self.data), self._filter(key))
        out = F.lit(True)
        for p in self._positions(key):
            byte = F.conv(F.hex(F.substring(data, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (byte.bitwiseAND(_bit(p)) != 0)
        return out


class Cascade:
    """Exact membership of ``listed`` keys within a universe of keys that includes them."""

    def __init__(self, listed: DataFrame, universe: DataFrame, universe_size: int, max_bits: int = 1 << 23, max_filters: int = 64):
        listed = settle(listed.select("key").where(F.col("key").isNotNull()).distinct())
        count = listed.count()
        self.levels: list[BloomLevel] = []
        if not count:
            return
        rate = min(0.5, max(2.0**-20, math.sqrt(0.5) * count / max(count, universe_size)))
        self.levels.append(BloomLevel(listed, count, rate, 1, max_bits, max_filters))
        inside = listed
        outside = settle(universe.where(self.levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti"))
        while wrong := outside.count():
            self.levels.append(BloomLevel(outside, wrong, 0.5, len(self.levels) + 1, max_bits, max_filters))
            inside, outside = outside, settle(inside.where(self.levels[-1].passes(F.col("key"))))

    def member(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            out = F.when(self.levels[k - 1].passes(key), out).otherwise(F.lit(k % 2 == 0))
        return out


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", *, default: str = "allow", max_bits: int = 1 << 23, max_filters: int = 64) -> DataFrame:
    """``pages`` ids with host, path, the longest fitting rule and its verdict, or ``default`` where no rule fits.

    ``rules``: host, path, verdict ('allow' or 'block'). Path lengths of the rules are gathered to the driver; they are
    distinct lengths of url paths, so a few thousand at most."""
    rules = rules.select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("verdict").alias("verdict")).where(F.col("host").isNotNull())
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = split_url(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = parsed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    universe = keyed.select(F.explode("keys.key").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    try:
        cascades = {v: Cascade(listed.where(F.col("verdict") == v), universe, size, max_bits, max_filters) for v in ("block", "allow")}
    except TooLarge:
        return _by_join(parsed, keyed, listed, default)
    hit = lambda v: F.array_max(F.filter("keys", lambda k: cascades[v].member(k["key"])))
    df = keyed.withColumns({"block": hit("block"), "allow": hit("allow")})
    blocked = F.col("block").isNotNull() & (F.col("allow").isNull() | (F.col("block") >= F.col("allow")))
    rule = F.when(blocked, F.col("block.key")).otherwise(F.col("allow.key"))
    verdict = F.when(blocked, "block").when(F.col("allow").isNotNull(), "allow").otherwise(default)
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _by_join(parsed: DataFrame, keyed: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The same by equi-joins on (host, path): the distinct hosts and paths are matched once, then joined back."""
    listed = listed.groupBy("key").agg(F.max("verdict").alias("verdict"))  # 'block' is the larger word
    pairs = keyed.select("host", "path", "keys").dropDuplicates(["host", "path"])
    best = pairs.select("host", "path", F.explode("keys").alias("k")).select("host", "path", "k", F.col("k.key").alias("key")).join(listed, "key").groupBy("host", "path").agg(F.max_by(F.struct("key", "verdict"), "k").alias("hit"))
    df = parsed.join(best, ["host", "path"], "left")
    return df.select("page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
