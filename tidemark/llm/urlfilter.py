"""URL filters: exact block lists as Bloom filter cascades, and longest-prefix rules.

Level 1 of a cascade encodes the listed keys, level 2 the keys of the corpus
that level 1 takes for listed by mistake, level 3 the listed keys that level 2
takes for mistakes, and so on until no mistake is left over the corpus's
complete key universe. Asking needs no join: a key is listed if the number of
leading levels that hold it is odd. Levels are arrays of 64-bit words that the
plan reads as scalar subqueries. A list that needs more than ``max_bytes`` is
split into shards by key hash, asked one after the other.

Null urls and urls without ``://`` have an empty host and path; no rule fits
them and they are not listed. Null listed keys are ignored; repeated ones count
once; an empty list lists nothing. Ties between rules of one length go to the
first by text. Extra columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import written

BITS, HASHES, MAX_BYTES = 12, 8, 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = "://([^/?#]*)([^?#]*)"
    get = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(get(1), UPPER, LOWER), get(2)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]], value: int) -> Column:
    """The rule (0) or its verdict (1), of the longest rule ``host/path`` that fits; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, slash, rest = rule[0].partition("/")
        name = name.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def _positions(key: Column, level: int, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + j)), F.lit(words * 64)) for j in range(HASHES)]


def _level(keys: DataFrame, level: int, words: int) -> DataFrame:
    """One row: the level's words."""
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, words))).alias("at"))
    found = at.select(F.shiftright("at", 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("w"))
    empty = spark.range(words).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    whole = found.union(empty).groupBy("i").agg(F.bit_or("w").alias("w"))
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words"))


class Cascade:
    """Exact membership of the keys in ``universe`` (a column ``key``) in ``listed``."""

    def __init__(self, universe: DataFrame, listed: DataFrame, bits: int = BITS):
        listed = written(listed.filter("key is not null").distinct(), "listed")
        other = universe.filter("key is not null").distinct().join(listed, "key", "left_anti")
        inside = universe.filter("key is not null").distinct().join(listed, "key", "left_semi")
        sides = [written(inside, "inside"), written(other, "outside")]  # of the universe: in the list, not in it
        self.levels: list[tuple[DataFrame, int]] = []
        coded = listed
        while (n := coded.count()) or not self.levels:
            level, words = len(self.levels), max(1, -(-n * bits // 64))
            self.levels.append((written(_level(coded, level, words), f"level{level}"), words))
            wrong = sides[1 - level % 2].filter(self._holds(F.col("key"), level))
            sides[1 - level % 2] = coded = written(wrong, f"mistakes{level}")

    def _holds(self, key: Column, level: int) -> Column:
        df, words = self.levels[level]
        held = df.scalar()
        return reduce(Column.__and__, [F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1 for at in _positions(key, level, words)])

    def holds(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(range(len(self.levels))):
            out = self._holds(key, level) & ~out
        return F.coalesce(out, F.lit(False))


def suffixes(host: Column, labels: int) -> list[Column]:
    """The host's last 1 to ``labels`` labels, and itself."""
    return [host, *(F.substring_index(host, ".", -k) for k in range(1, labels + 1))]


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages with host, path, rule, listed and verdict; ``listed`` has one column ``host`` of names that are blocked with their subdomains."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    out = out.withColumns({"rule": rule_column(F.col("host"), F.col("path"), rules, 0), "rule_verdict": rule_column(F.col("host"), F.col("path"), rules, 1)})
    names = listed.select(F.translate("host", UPPER, LOWER).alias("key")).filter("key <> ''").distinct()
    n, labels = names.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("key", r"\."))), F.lit(0))).first()
    shards = max(1, -(-n * BITS // (8 * max_bytes)))
    hosts = out.select("host").distinct()
    universe = written(hosts.select(F.explode(F.array_distinct(F.array(*suffixes(F.col("host"), labels)))).alias("key")).distinct(), "universe")
    part = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards))
    out = out.withColumn("listed", F.lit(False))
    for k in range(shards):
        cascade = Cascade(universe.filter(part == k), names.filter(part == k))
        asked = [cascade.holds(s) & (F.pmod(F.xxhash64(s, F.lit(-1)), F.lit(shards)) == k) if shards > 1 else cascade.holds(s) for s in suffixes(F.col("host"), labels)]
        out = out.withColumn("listed", F.col("listed") | reduce(Column.__or__, asked))
        if k < shards - 1:
            out = written(out, f"asked{k}")
    verdict = F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).drop("rule_verdict")
