"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source token shares p are exponentiated, w ~ p ** a.  Bisection finds the
largest a in [0, 1] whose entropy reaches a target share of the maximum, and the
smallest a whose most repeated source stays within a limit of epochs; the larger
of the two is used, so the repetition limit wins; without an entropy target the limit
alone sets it.  The bisection is one
higher-order function over a row that holds the source shares.

A source's budget is whole epochs plus a part.  The part is a prefix of a block
permutation: hashes deal documents to 1024 blocks a source and 1024 sub-blocks
in each, blocks are permuted by hash, whole blocks are taken while they fit, then
whole sub-blocks of the first block that doesn't.  A budget is never exceeded
and at most one sub-block short.  Windows see block sums only, never documents,
so a source with a third of all rows costs no more than another.

Up to ``MAX_SOURCES`` sources the shares are one row; beyond that each step of the same
bisection is an aggregation over them.  Broadcast: one row for each source, checked against ``BROADCAST_SOURCES``;
beyond that a salted shuffle join.

Defined results: a null source is a source of its own; null or empty texts have
no tokens and follow their block; rows with equal id and text share one fate; an
empty table gives an empty result; extra columns stay, but that ``mixed`` replaces n_tokens,
weight, epochs and copies; a very long text is one document and follows its block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import WORD, let, table, written

MAX_SOURCES = 1_000_000
BROADCAST_SOURCES = 100_000
STEPS = 60


def _placed(docs: DataFrame, seed: int) -> DataFrame:
    """docs with source key, token count and its permuted block and sub-block."""
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    key = F.coalesce(F.col("source").cast("string"), F.lit("\u0000"))
    block, sub = F.shiftrightunsigned(h, 54), F.pmod(F.shiftrightunsigned(h, 44), F.lit(1024))
    return docs.withColumns({
        "__src": key,
        "__n": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"),
        "__o": F.xxhash64(F.lit(seed + 1), key, block),
        "__o2": F.xxhash64(F.lit(seed + 2), key, block, sub),
    })


def temperature(shares: Column, entropy: float | None, max_epochs: float | None, budget: Column | None) -> Column:
    """struct(a, weights, budget share) for an array of positive shares; budget is
    in units of all tokens, None: as many as give every source one whole epoch."""
    zero = F.lit(0.0)
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    weights = lambda a: let(F.transform(shares, lambda p: F.pow(p, a)), lambda r: let(total(r), lambda z: F.transform(r, lambda x: x / z)))
    spread = lambda w: -F.aggregate(w, zero, lambda s, x: s + x * F.log(x))
    epochs = lambda w: F.array_max(F.zip_with(w, shares, lambda x, p: x / p))
    cover = lambda w: F.array_max(F.zip_with(w, shares, lambda x, p: p / x))
    size = (lambda w: cover(w)) if budget is None else (lambda w: F.least(budget, F.lit(float(max_epochs or 1e18))))

    def bisect(good) -> Column:
        """The end of [0, 1] that stays good: good(w) holds on one side."""
        start = F.struct(zero.alias("lo"), F.lit(1.0).alias("hi"))

        def step(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            return let(good(weights(mid)), lambda up: F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)

    n = F.size(shares)
    high = zero if entropy is None else F.when(spread(shares) >= entropy * F.log(n.cast("double")), F.lit(1.0)).otherwise(bisect(lambda w: spread(w) >= entropy * F.log(n.cast("double")))["lo"])
    low = zero if max_epochs is None else F.when(epochs(weights(zero)) * size(weights(zero)) <= max_epochs, zero).otherwise(bisect(lambda w: epochs(w) * size(w) > max_epochs)["hi"])
    return let(F.greatest(high, low), lambda a: let(weights(a), lambda w: F.struct(a.alias("a"), w.alias("w"), size(w).alias("size"))))


def _many_sources(per: DataFrame, all_: float, n: int, entropy: float | None, max_epochs: float | None, budget_tokens: float | None, cover: bool) -> DataFrame:
    """The same plan where the shares fill no single row: each step of the bisection is one
    aggregation over per(__src, tokens)."""
    p = F.col("tokens") / F.lit(all_)

    def at(a: float) -> dict[str, float]:
        r = per.agg(F.sum(F.pow(p, F.lit(a))).alias("z"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias("l"), F.max(F.pow(p, F.lit(a - 1))).alias("up"), F.max(F.pow(p, F.lit(1 - a))).alias("down")).first()
        size = r.z * r.down if cover else min(1.0 if budget_tokens is None else budget_tokens / all_, float(max_epochs or 1e18))
        return {"z": r.z, "spread": float(np.log(r.z)) - a * r.l / r.z, "epochs": r.up / r.z * size, "size": size}

    def bisect(good) -> tuple[float, float]:
        lo, hi = 0.0, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(at(mid)) else (lo, mid)
        return lo, hi

    least = None if entropy is None else entropy * float(np.log(n))
    high = 0.0 if entropy is None else 1.0 if at(1.0)["spread"] >= least else bisect(lambda x: x["spread"] >= least)[0]
    low = 0.0 if max_epochs is None or at(0.0)["epochs"] <= max_epochs else bisect(lambda x: x["epochs"] > max_epochs)[1]
    a = max(high, low)
    x = at(a)
    weight = F.pow(p, F.lit(a)) / F.lit(x["z"])
    return per.select("__src", "tokens", F.lit(a).alias("exponent"), weight.alias("weight"), (weight * F.lit(x["size"] * all_)).alias("target"))


def source_plan(placed: DataFrame, entropy: float | None, max_epochs: float | None, budget_tokens: float | None, cover: bool, max_sources: int | None = None) -> DataFrame:
    """One row a source: weight, exponent, whole epochs and the cut of the partial one."""
    max_sources = MAX_SOURCES if max_sources is None else max_sources
    sums = written(placed.groupBy("__src", "__o").agg(F.sum("__n").alias("n")))
    per = written(sums.groupBy("__src").agg(F.sum("n").alias("tokens")).where("tokens > 0"))
    row = per.agg(F.sum("tokens").cast("double").alias("all"), F.count("*").alias("sources")).first()
    if row.sources <= max_sources:
        one = per.agg(F.sort_array(F.collect_list(F.struct("__src", "tokens"))).alias("s")).select("s", F.lit(row["all"]).cast("double").alias("all"))
        share = F.transform("s", lambda x: x["tokens"] / F.col("all"))
        budget = None if cover else F.lit(1.0) if budget_tokens is None else F.lit(float(budget_tokens)) / F.col("all")
        mixed = one.where("size(s) > 0").select("s", "all", temperature(share, entropy, max_epochs, budget).alias("m"))
        one = mixed.select("all", "m", F.posexplode("s").alias("i", "x")).select(F.col("x.__src").alias("__src"), F.col("x.tokens").alias("tokens"), F.col("m.a").alias("exponent"), F.get("m.w", F.col("i")).alias("weight"), (F.get("m.w", F.col("i")) * F.col("m.size") * F.col("all")).alias("target"))
    else:
        one = _many_sources(per, row["all"], row.sources, entropy, max_epochs, budget_tokens, cover)
    epochs = F.round(F.col("target") / F.col("tokens"), 9)
    one = written(one.withColumns({"epochs": epochs, "whole": F.floor(epochs).cast("int"), "rest": (epochs - F.floor(epochs)) * F.col("tokens")}))
    cum = F.sum("n").over(W.partitionBy("__src").orderBy("__o"))
    cut = sums.withColumn("cum", cum).join(one.select("__src", "rest"), "__src").where("cum > rest").groupBy("__src").agg(F.min(F.struct("__o", (F.col("cum") - F.col("n")).alias("before"), "rest")).alias("c")).select("__src", F.col("c.__o").alias("cut"), (F.col("c.rest") - F.col("c.before")).alias("left"))
    cut = written(cut)
    inner = placed.select("__src", "__o", "__o2", "__n").join(F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut, (placed["__src"] == cut["__src"]) & (F.col("__o") == F.col("cut"))).select(cut["__src"], "__o2", "__n", "left")
    subs = inner.groupBy("__src", "left", "__o2").agg(F.sum("__n").alias("n")).withColumn("cum", F.sum("n").over(W.partitionBy("__src").orderBy("__o2")))
    cut2 = subs.where("cum > left").groupBy("__src").agg(F.min("__o2").alias("cut2"))
    return one.join(cut.select("__src", "cut"), "__src", "left").join(cut2, "__src", "left").select("__src", "weight", "exponent", "epochs", "whole", "cut", "cut2")


def mixed(docs: DataFrame, entropy: float | None = 0.95, max_epochs: float | None = 4.0, budget_tokens: float | None = None, cover: bool = False, seed: int = 17, with_text: bool = True) -> DataFrame:
    """docs with n_tokens, weight, epochs and copies: how often the mixture takes each.
    cover: the budget gives each source one whole epoch at least, so no row is lost.
    with_text False: docs without text, whose words are then counted in one pass only."""
    new = {"n_tokens", "weight", "epochs", "copies"}  # take the place of input columns of these names
    out = [c for c in docs.columns if c not in new and (with_text or c != "text")]
    packed = docs.select(F.struct(*out).alias("__row"), "doc_id", "text", "source")
    placed = _placed(packed, seed)
    small = written(placed.select("__src", "__n", "__o", "__o2", *([] if with_text else ["__row"])))
    placed = placed if with_text else small
    plan = written(source_plan(small.select("__src", "__n", "__o", "__o2"), entropy, max_epochs, budget_tokens, cover))
    plan = plan.select("__src", *[F.col(c).alias(f"__{c}") for c in plan.columns if c != "__src"])
    if plan.count() <= BROADCAST_SOURCES:
        joined = placed.join(F.broadcast(plan), "__src", "left")
    else:  # one source may hold a third of all rows
        salts = F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>"))
        joined = placed.withColumn("__salt", F.pmod("__o2", F.lit(64))).join(plan.withColumn("__salt", salts), ["__src", "__salt"], "left").drop("__salt")
    part = F.col("__cut").isNull() | (F.col("__o") < F.col("__cut")) | ((F.col("__o") == F.col("__cut")) & (F.col("__cut2").isNull() | (F.col("__o2") < F.col("__cut2"))))
    copies = F.coalesce("__whole", F.lit(int(cover))) + F.when(F.col("__epochs").isNotNull() & (F.col("__epochs") > F.col("__whole")) & part, 1).otherwise(0)
    return joined.select(*[F.col("__row")[c].alias(c) for c in out], F.col("__n").alias("n_tokens"), F.col("__weight").alias("weight"), F.col("__epochs").alias("epochs"), copies.cast("int").alias("copies"))


def realised(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it."""
    packed = docs.select(F.struct("*").alias("__whole_row"), "doc_id", "text", "source")
    out = mixed(packed, **how).select("__whole_row", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>"))).alias("__epoch"))
    return out.select("__whole_row.*")


def op4_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixed(docs, with_text=False)
    return out.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), F.round("epochs", 6).alias("epochs"), "copies")
