"""URL rules by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and a path prefix, written ``host/path``; it fits its host, all subdomains, and every
path that starts with its own.  A url's candidate keys are the host suffixes at dots, each followed by the
path prefixes of the lengths that occur among the rules.  The cascade answers "is this key listed?" exactly
for every candidate key of the corpus: level 1 holds the listed keys, level 2 the unlisted corpus keys that
pass level 1, level 3 the listed keys that pass level 2, and so on until no key is wrong.  The first level
that a key fails decides.  Level 1 is sized by how many unlisted keys the corpus has for each listed one, so that about as
many pass it as are listed; later levels halve.  Allow rules and block rules have a cascade each, so a candidate's answer is its
verdict too, and no url is joined with the rules.

Keys are dealt into shards by hash, as many as keep a level below MOST_BYTES, and each shard has cascades of its own; one
shard's levels are held by the executors at a time.  Candidates are tested as rows, for which a task holds a level once;
only the hits of a url, mostly none or one, come together again.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; the verdict is then
``default``.  Longest rule string wins; of equally long ones the one with the longer host.  A rule that is listed with both actions blocks.
Empty rule lists and empty tables work; columns of the input named host, path, rule or verdict are replaced, other extra
columns stay.  Repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bloom, free_name, keep, located, row_key, shared_folder

#: The most bytes of a level; longer lists go in more shards.
MOST_BYTES = 8 << 20

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys a rule could have that fits, longest first (ties: longer host first)."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((-F.length(s) - F.length(p)).alias("o"), (-F.length(s)).alias("h"), F.concat(s, p).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def level_size(listed: int, others: int, level: int) -> tuple[int, int]:
    """(bits for each key, hash functions) of a level: the first passes about listed / sqrt(2) of the others, later ones half."""
    hashes = max(1, math.ceil(math.log2(max(2.0, math.sqrt(2) * others / max(1, listed))))) if level == 0 else 1
    return math.ceil(hashes / math.log(2)), hashes


class Cascade:
    """Exact membership for the keys of ``universe`` (key, listed); its levels are tables in the shared folder."""

    def __init__(self, universe: DataFrame, folder: str) -> None:
        self.levels: list[Bloom] = []
        inside, outside = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
        n, others = inside.count(), outside.count()
        while n:
            level = len(self.levels)
            bits, hashes = level_size(n, others, level)
            self.levels.append(Bloom(inside, n * bits, hashes, folder, f"level{level}", seed=100 * level))
            inside, outside = keep(outside.filter(self.levels[-1].passes(F.col("key"))), folder, f"wrong{level}"), inside
            n = inside.count()

    def contains(self, key: Column) -> Column:
        """The first level that a key fails decides: an odd one (counted from 0) means listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[level].passes(key), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict.  rules: (action ``allow`` or ``block``, rule)."""
    folder = shared_folder(pages.sparkSession)
    pages = located(pages, folder)
    rules = keep(rules.filter("rule is not null").groupBy("rule").agg(F.max("action").alias("action")), folder, "rules")
    lengths = [r[0] for r in rules.select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().orderBy("n").collect()]
    host, path, row = host_of(F.col(url)), path_of(F.col(url)), free_name(pages, "_row")
    out = pages.withColumn(row, row_key()).select(row, *[c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")], host.alias("host"), path.alias("path"))
    if not lengths:
        return out.drop(row).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidates(F.col("host"), F.col("path"), lengths)
    corpus = pages.select(host.alias("host"), F.substring(path, 1, max(lengths)).alias("path")).distinct().select(F.explode(keys).alias("key"), F.lit(0).alias("l"))
    listing = rules.select(F.col("rule").alias("key"), F.when(F.col("action") == "block", 2).otherwise(1).alias("l"))
    universe = keep(corpus.unionByName(listing).groupBy("key").agg(F.max("l").alias("l")), folder, "universe")
    size = universe.agg(F.count_if(F.col("l") > 0).alias("listed"), F.count_if(F.col("l") == 0).alias("others")).first()
    shards = max(1, -(-size["listed"] * level_size(size["listed"], size["others"], 0)[0] // (8 * most_bytes)))
    shard = F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(shards))
    asked = pages.select(row_key().alias(row), host.alias("host"), path.alias("path")).select(row, F.posexplode(keys).alias("at", "key"))
    found = []
    for s in range(shards):
        own = universe.filter(shard == s)
        block = Cascade(own.select("key", (F.col("l") == 2).alias("listed")), f"{folder}/block{s}")
        allow = Cascade(own.select("key", (F.col("l") == 1).alias("listed")), f"{folder}/allow{s}")
        action = F.when(block.contains(F.col("key")), "block").when(allow.contains(F.col("key")), "allow")
        hits = asked.filter(shard == s).withColumn("action", action).filter("action IS NOT NULL")
        found.append(keep(hits, folder, f"hits{s}") if shards > 1 else hits)
    hits = found[0]
    for other in found[1:]:
        hits = hits.unionByName(other)
    best = hits.groupBy(row).agg(F.min_by(F.struct(F.col("key").alias("rule"), "action"), "at").alias("_hit"))
    return out.join(best, row, "left").drop(row).withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce("_hit.action", F.lit(default))}).drop("_hit")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{r}')" for a, r in RULES) + " AS r(action, rule)")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH p AS (
  SELECT page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE
      translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE
      regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
r(action, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
m AS (
  SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(rhost) DESC) AS n
  FROM p JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1
"""
