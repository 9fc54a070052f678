"""URL filters: prefix rules, then a Bloom filter cascade over listed domains, with DataFrame functions only.

A host is blocked by the list if it, or a domain above it, is listed. Keys are therefore hosts with all domains above
them, and the corpus's complete key universe is known: the distinct keys of all its urls. Level 0 of the cascade is a
Bloom filter over the listed keys of the universe; the other keys that pass it by mistake go into the filter of level 1, the
listed keys that pass that one by mistake into level 2, and so on until nobody passes by mistake. For every
key of the universe the first level it doesn't pass gives the exact answer, so rows are judged where they are, without joins or
shuffles. The filters hold about ``1.44 * log2(universe / listed) + 6`` bits for each listed key; each is a table of one row, which
tasks get as the result of a scalar subquery, so plans don't grow with the list. Only domains of up to as many labels as the longest listed one are
asked for. A list of more than ``max_keys`` keys of the universe (or of more than :data:`MOST_LABELS` labels) is no filter of bounded size: it is joined
with the distinct hosts instead, to the same verdicts.

The query's list is derived from the corpus's own keys: :func:`named_keys` takes every domain whose first label is a listed name, under any suffix.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed; an empty list blocks
nothing; a listed key outside the corpus costs nothing; duplicate rows and keys change nothing; new columns
replace those of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from meshframes.llm.common import stored

MOST_LABELS = 16
MAX_KEYS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path prefix)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Names whose domains the query lists as blocked, under any suffix.
NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: up to ``/``, ``?`` or ``#`` (A-Z lower-cased); from there up to ``?`` or ``#``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equally long ones a block, then the first by text), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(ordered):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domains(host: Column) -> Column:
    """The host and the domains above it; an empty host has none."""
    parts = F.split(host, r"\.")
    return F.when(
        host == "", F.array().cast("array<string>")
    ).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def universe_of(hosts: DataFrame) -> DataFrame:
    """(key): the distinct keys of ``hosts`` (host)."""
    return hosts.distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()


def named_keys(universe: DataFrame, names: Sequence[str]) -> DataFrame:
    """The keys of ``universe`` whose first label is one of ``names``."""
    return universe.select("key").where(F.substring_index("key", ".", 1).isin(list(names))).distinct()


class TooManyKeys(ValueError):
    pass


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    probes: int
    words: DataFrame | None  # one row: the filter as an array of 64-bit words

    def positions(self, key: Column) -> list[Column]:
        a = F.pmod(F.xxhash64(F.lit(2 * self.seed), key), F.lit(self.bits))
        b = F.pmod(F.xxhash64(F.lit(2 * self.seed + 1), key), F.lit(self.bits))
        return [(a + b * i) % self.bits for i in range(self.probes)]

    def passes(self, key: Column) -> Column:
        out = F.lit(True)
        words = self.words.scalar()
        for p in self.positions(key):
            word = F.get(words, F.floor(p / 64).cast("int"))
            out = out & (F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out


def make_level(keys: DataFrame, n: int, chance: float, seed: int) -> Level:
    """A filter over ``n`` keys which others pass with probability ``chance`` or so."""
    probes = max(1, round(math.log2(1 / chance)))
    empty = Level(seed, max(64, 64 * math.ceil(n * probes / math.log(2) / 64)), probes, None)
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    blank = keys.sparkSession.range(empty.bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    found = at.select(F.floor(F.col("p") / 64).alias("w"), one.alias("v")).unionByName(blank).groupBy("w").agg(F.bit_or("v").alias("v"))
    # bits / 64 words, bounded by the keys
    row = found.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("s")).select(F.transform("s", lambda x: x["v"]).alias("words"))
    return Level(seed, empty.bits, probes, stored(row, "url-filter"))


def build(universe: DataFrame, listed: DataFrame, max_keys: int = MAX_KEYS) -> list[Level]:
    """The cascade for ``listed`` (key) over all distinct keys of ``universe`` (key)."""
    marked = stored(
        universe.select("key").where(F.col("key").isNotNull()).distinct()
        .join(listed.select("key").distinct().withColumn("inside", F.lit(True)), "key", "left")
        .select("key", F.coalesce("inside", F.lit(False)).alias("inside")), "url-keys")
    count = {r.inside: r["count"] for r in marked.groupBy("inside").count().collect()}
    n, rest = count.get(True, 0), count.get(False, 0)
    if n > max_keys:
        raise TooManyKeys(f"{n} listed keys; max_keys is {max_keys}")
    levels: list[Level] = []
    held, other = marked.where("inside"), marked.where("not inside")
    while n:
        chance = min(0.5, n / max(1, rest) / math.sqrt(2)) if not levels else 0.5
        levels.append(make_level(held, n, chance, len(levels)))
        # what passes the new filter by mistake must be held by the next one
        wrong = stored(other.where(levels[-1].passes(F.col("key"))), "url-level")
        held, other, n = wrong, held, wrong.count()
    return levels


def is_listed(key: Column, levels: Sequence[Level]) -> Column:
    """Exact for keys of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def _labels(listed: DataFrame) -> int:
    """Labels of the longest listed key."""
    return listed.agg(F.max(F.size(F.split("key", r"\."))).alias("n")).first()["n"] or 0


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", max_keys: int = MAX_KEYS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``: the longest rule's, else block for listed domains, else allow."""
    names = ["host", "path", "rule", "verdict"]
    host, path = host_and_path(F.col(url))
    hosts = pages.select(host.alias("host"))
    kept = [c for c in pages.columns if c not in names]
    parsed = pages.select("*", host.alias("__llm_host"), path.alias("__llm_path"))
    labels = _labels(listed)
    try:
        if labels > MOST_LABELS:
            raise TooManyKeys
        levels = build(universe_of(hosts), listed, max_keys)
    except TooManyKeys:
        own = hosts.distinct().select(F.col("host").alias("__llm_b"), F.explode(domains(F.col("host"))).alias("key"))
        bad = own.join(listed.select("key").distinct(), "key", "left_semi").select("__llm_b").distinct()
        parsed = parsed.join(bad, F.col("__llm_host") == F.col("__llm_b"), "left")
        blocked = F.col("__llm_b").isNotNull()
    else:
        blocked = F.lit(False)
        for n in range(1, labels + 1) if levels else ():  # of a host with fewer labels this is the host again
            blocked = blocked | is_listed(F.substring_index("__llm_host", ".", -n), levels)
        blocked = blocked & (F.col("__llm_host") != "")
    fit = parsed.withColumn("__llm_rule", rule_of(F.col("__llm_host"), F.col("__llm_path"), rules))
    own = F.when(blocked, "block").otherwise("allow")
    return fit.select(*kept, F.col("__llm_host").alias("host"), F.col("__llm_path").alias("path"), F.col("__llm_rule.rule").alias("rule"), F.coalesce("__llm_rule.verdict", own).alias("verdict"))


#: DuckDB SQL for :func:`judge` over ``pages``, with the default rules and the keys of :data:`NAMES`.
SQL = """
WITH parsed AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
ruled AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN len(list_intersect(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])) > 0
    THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
