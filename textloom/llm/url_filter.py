"""URL filter: blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a canonical URL prefix, host + path, with a verdict.  A URL can only be
hit by a key made of one of its host's domain suffixes and a prefix of its path, so only
prefixes up to the URL's own length are made, of lengths that occur in the list.  Whatever
the number of listed lengths, a URL takes a slice of them; none is left out.
Keys are tested against a Bloom filter of 64-bit blocks (one block, four
bits a key) inside the scan's projection.  URLs without a possible hit pass
straight through; the others join the list exactly by key, which removes false
positives, and the longest fitting entry gives the verdict.

The filter is built with DataFrame aggregation and is bounded: at most
``max_blocks`` blocks (1 MB by default), whatever the list's size; a fuller
filter only sends more URLs to the exact join.  The list of lengths has a number for each
distinct path length of the list, at most as many as its longest path has characters.

Defined results: a null URL, or one without ``://``, has an empty host and path
and gets the default verdict; an empty list gives the default verdict to all; a key listed
with two verdicts has the smaller one in text order (allow before block); very long URLs are
judged whole; repeated rows and page ids are judged one by one; extra columns stay, but for
host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import let, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the op7 contract (fixed values).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BITS = 4


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _hashes(key: Column) -> Column:
    """128 bits that stand for a key."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit("bits")).alias("g"))


def _block(k: Column, blocks: int) -> Column:
    return F.pmod(k["h"], F.lit(blocks)).cast("int")


def _mask(k: Column) -> Column:
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(k["g"], 16 * i), F.lit(64)).cast("int")))
    return mask


def _lookup(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")


def _fitting(lengths: list[int], n: Column) -> Column:
    """The listed lengths up to n: a slice of the sorted list, found by two look-ups, as
    ``upto[i]`` of them are below 64 * i."""
    top = max(lengths, default=0)
    upto, k = [], 0
    for i in range(top // 64 + 2):
        while k < len(lengths) and lengths[k] < 64 * i:
            k += 1
        upto.append(k)
    step = F.least(F.floor(n / 64), F.lit(top // 64)).cast("int")
    low, high = F.get(_lookup(upto), step), F.get(_lookup(upto), step + 1)
    every = _lookup(lengths)
    near = F.filter(F.slice(every, (low + 1).cast("int"), (high - low).cast("int")), lambda x: x <= n)  # 64 at most
    return F.concat(F.slice(every, F.lit(1), low.cast("int")), near)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_blocks: int = 1 << 17) -> DataFrame:
    """pages with host, path, rule and verdict; rules(host, path, verdict)."""
    listed = rules.select(F.concat("host", "path").alias("__key"), F.col("verdict").alias("__verdict"), F.length("path").alias("__n")).groupBy("__key").agg(F.min("__verdict").alias("__verdict"), F.min("__n").alias("__n")).withColumn("__hash", _hashes(F.col("__key")))
    lengths = sorted(r[0] for r in listed.select("__n").distinct().toLocalIterator())
    blocks = max(1, min(max_blocks, listed.count() // 4 + 1))
    words = listed.groupBy(_block(F.col("__hash"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("__hash"))).alias("word"))
    by_block = {r.block: r.word for r in words.toLocalIterator()}  # at most max_blocks words
    filt = _lookup([by_block.get(i, 0) for i in range(blocks)])

    new = ["host", "path", "rule", "verdict"]
    parsed = pages.select(*[c for c in pages.columns if c not in new], F.col(url).alias("__url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(let(F.split(F.col("host"), r"\.", -1), lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, F.size(x)), "."))))
    maybe = lambda k: let(_mask(k), lambda m: F.get(filt, _block(k, blocks)).bitwiseAND(m) == m)
    prefix = lambda s, n: let(F.concat(s, F.substr(F.col("path"), F.lit(1), n.cast("int"))), _hashes)
    hits = let(_fitting(lengths, F.length("path")), lambda ns: F.flatten(F.transform(suffixes, lambda s: F.filter(F.transform(ns, lambda n: prefix(s, n)), maybe))))
    parsed = parsed.withColumn("__hits", hits)
    none = parsed.where("size(__hits) = 0").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    some = parsed.where("size(__hits) > 0")
    # Exact join of the possible hits, once for each distinct set of keys; most URLs share few sets.
    some = some.withColumn("__set", F.struct(F.xxhash64("__hits").alias("h"), F.xxhash64("__hits", F.lit(1)).alias("g")))
    sets = some.groupBy("__set").agg(F.first("__hits").alias("__hits")).select("__set", F.explode("__hits").alias("__hash"))
    best = sets.join(listed.select("__hash", F.length("__key").alias("__len")), "__hash").groupBy("__set").agg(F.max_by("__hash", "__len").alias("__hash"))
    true = best.join(listed.select("__hash", F.struct("__key", "__verdict").alias("__best")), "__hash").drop("__hash")
    spread = true.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>")))
    # A set may be shared by most rows, and a URL too, so the salt is drawn from the row.
    done = some.withColumn("__salt", F.pmod(F.xxhash64("__url", F.monotonically_increasing_id()), F.lit(64))).join(spread, ["__set", "__salt"], "left")
    # The wording itself decides: some suffix of the host with a prefix of the path is the key.
    key = F.col("__best.__key")
    fits = F.coalesce(F.exists(suffixes, lambda s: F.startswith(key, s) & F.startswith(F.concat(s, F.col("path")), key)), F.lit(False))
    done = done.withColumns({"rule": F.when(fits, F.col("__best.__key")), "verdict": F.coalesce(F.when(fits, F.col("__best.__verdict")), F.lit(default))}).drop("__best", "__salt", "__set")
    return none.unionByName(done).drop("__hits", "__url")


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL_OP7 = """
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, max(h || q ORDER BY length(h || q)) AS rule, coalesce(max(v), 'allow') AS verdict FROM (
  SELECT u.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) WHERE k = 1
GROUP BY page_id, host, path
"""
