"""URL filtering by Bloom filter cascades, with built-in functions only.

A rule is a host and the beginning of a path. What a url could match is known
beforehand: its host and the domains above it, each with the beginnings of its
path that are as long as some rule's path. These candidates of all urls are the
key universe of the corpus. For each list (blocked, allowed) a cascade holds
exactly the listed ones of them:

1. The first level is a Bloom filter of the listed keys. Every candidate of the
   corpus is held against it; only those that pass go on to a grouping.
2. Those that pass and aren't listed are its false positives; they are the second
   level's keys. Listed keys that pass the second level are the third's, and so
   on, until a level has no false positive among the keys of the universe.

A url is then judged in its own row: no join, no shuffle, and the filter is a
constant of the plan. A filter holds at most ``KEYS`` keys; longer lists are dealt
into slices by hash, and the urls pass one slice after the other.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyspark.llm.common import discard, materialize

#: Listed keys of one slice's filter, and hashes of the levels below the first.
KEYS, BELOW = 1 << 20, 4
#: Bits of a bitmap of ``bitmap_construct_agg``.
_BUCKET = 32768


class Level(NamedTuple):
    bits: bytes
    size: int
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        """Whether every bit of ``key`` is set; the first that isn't ends the test."""
        filled = F.lit(self.bits)

        def is_set(i: Column) -> Column:
            at = _place(key, self, i)
            byte = F.conv(F.hex(F.substring(filled, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (at % 8).cast("int")) == 1

        return F.forall(F.array(*[F.lit(i) for i in range(self.hashes)]), is_set)


def _place(key: Column, level: Level, i: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level.seed), i), F.lit(level.size).cast("long"))


def bloom(keys: DataFrame, n: int, hashes: int, seed: int) -> Level:
    """A filter of the ``n`` values of ``key``; bitmaps are filled before they are shuffled."""
    level = Level(b"", -(-max(64, math.ceil(n * hashes / math.log(2))) // 8) * 8, hashes, seed)
    places = keys.select(F.explode(F.array(*[_place(F.col("key"), level, F.lit(i)) for i in range(hashes)])).alias("at"))
    maps = places.groupBy(F.floor(F.col("at") / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("bits")).collect()
    filled = bytearray(-(-level.size // _BUCKET) * _BUCKET // 8)
    for r in maps:
        start = r["bucket"] * _BUCKET // 8
        filled[start : start + len(r["bits"])] = r["bits"]
    return level._replace(bits=bytes(filled[: level.size // 8]))


def listed(levels: list[Level], key: Column) -> Column:
    """Whether the cascade holds ``key``; exact for keys of its universe."""
    inside = levels[-1].has(key)
    for level in reversed(levels[:-1]):
        inside = level.has(key) & ~inside
    return inside


def cascade(keys: DataFrame, n: int, universe: DataFrame, n_universe: int, below: int = BELOW, first: int | None = None) -> list[Level]:
    """Levels that tell exactly which keys of ``universe`` (``key``, with repeats) are among the ``n`` distinct ``keys``.

    ``n_universe`` is an upper bound of the universe's size. With it the first level's
    rate of false positives is chosen so that they are about as few as the listed
    keys; so no level outgrows the first.
    """
    hashes = first or min(40, max(4, math.ceil(math.log2(max(2, n_universe / n)))))
    levels = [bloom(keys, n, hashes, 0)]
    passed = universe.where(levels[0].has(F.col("key"))).select("key", F.lit(1).alias("seen"), F.lit(0).alias("listed"))
    known = passed.distinct().unionByName(keys.select("key", F.lit(0).alias("seen"), F.lit(1).alias("listed")))
    sides = materialize(known.groupBy("key").agg(F.max("seen").alias("seen"), F.max("listed").alias("listed")).where("seen = 1").select("key", "listed"), "sides")
    wrong, right = sides.where("listed = 0"), sides.where("listed = 1")
    while left := wrong.count():
        levels.append(bloom(wrong, left, below, len(levels)))
        wrong, right = right.where(levels[-1].has(F.col("key"))), wrong
    discard(sides)
    return levels


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased, and from there up to ``?``, ``#`` or the end; else ''."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def candidates(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """Keys that a url could match: (length, host length, key) for each domain of ``depths`` labels and path beginning of ``lengths``."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.filter(F.array(*map(F.lit, depths)), lambda d: d <= F.size(labels)), lambda d: F.array_join(F.slice(labels, -d, d), "."))
    paths = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    both = lambda h, p: F.struct((F.length(h) + F.length(p)).alias("length"), F.length(h).alias("host_length"), F.concat(h, p).alias("key"))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: both(h, p))))


def _longest(levels: list[Level]) -> Column:
    return F.array_max(F.filter("could", lambda c: listed(levels, c["key"])))


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", keys: int = KEYS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    ``rules``: host, path and verdict (block or allow). A rule fits its host and
    all domains below it if the path begins with its path. The longest rule wins, of equally
    long ones that with the longer host, and block where both verdicts are given for one rule. Urls that no rule fits get
    ``otherwise`` and a null rule. Null urls and those without ``://`` have an empty
    host and path. Repeated rows are judged each; other columns are ignored; an
    empty table gives an empty result, and without rules nothing is fitted.
    Rules with a null are ignored; hosts of rules are taken without regard to the case of A-Z.
    """
    host, path = host_and_path(F.col("url"))
    lowered = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = rules.where("host is not null and path is not null and verdict in ('block', 'allow')").select(lowered.alias("host"), "path", "verdict")
    known = materialize(known.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.", -1)).alias("depth"), F.length("path").alias("length"), "verdict").distinct(), "rules")
    # as many numbers as a rule's host has labels, or its path characters, at most
    depths, lengths = (sorted(r[0] for r in known.select(c).distinct().collect()) for c in ("depth", "length"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("could", candidates(F.col("host"), F.col("path"), depths, lengths) if depths else F.array().cast("array<struct<length int, host_length int, key string>>"))
    rows = rows.withColumn("best", F.lit(None).cast("struct<length int, host_length int, block int, key string>"))
    n_universe = pages.count() * len(depths) * len(lengths)
    slices = -(-known.count() // keys)
    for s in range(slices):
        part = known.where(F.pmod(F.xxhash64("key", F.lit("slice")), F.lit(slices)) == s)
        found = []
        for block, verdict in ((1, "block"), (0, "allow")):
            own = part.where(F.col("verdict") == verdict).select("key").distinct()
            if n := own.count():
                levels = cascade(own, n, rows.select(F.explode("could.key").alias("key")), n_universe)
                fits = _longest(levels)
                found.append(F.when(fits.isNotNull(), F.struct(fits["length"].alias("length"), fits["host_length"].alias("host_length"), F.lit(block).alias("block"), fits["key"].alias("key"))))
        rows = rows.withColumn("best", F.greatest("best", *found)) if found else rows
        if s + 1 < slices:  # a plan holds the filters of one slice
            before, rows = rows, materialize(rows, "judged")
            discard(before)
    discard(known)
    verdict = F.when(F.col("best").isNull(), otherwise).when(F.col("best.block") == 1, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id of the rows of ``pages`` whose url is allowed."""
    return judge_urls(pages, rules, otherwise).where("verdict = 'allow'").select("page_id")


def oracle(rules: list[tuple[str, str, str]]) -> str:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    lower = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rules(h, p, v) AS (VALUES {rows}),
  u AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS r FROM pages),
  f AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN f USING (r)
"""
