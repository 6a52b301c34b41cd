"""Labelling with three prompts, a cache table and a pluggable rater."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators.evaluate import majority_vote
from textloom.sources.shared import written


#: Prompts that are Python strings at once.
SLICE = 256


def prompt_keys(df: DataFrame, provider: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, prompt_no, prompt, cache_key): the three prompts of each text."""
    prompts = F.array(*[F.struct(F.lit(i).alias("prompt_no"), S.prompt(F.col(text), p).alias("prompt")) for i, p in enumerate(S.PROMPTS, 1)])
    rows = df.select(key, F.explode(prompts).alias("p")).select(key, "p.*")
    return rows.withColumn("cache_key", S.cache_key(F.lit(provider), F.lit(model), F.col("prompt")))


def cached(keys: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with label, misses) against cache(cache_key, label)."""
    return keys.join(cache, "cache_key"), keys.join(cache, "cache_key", "left_anti")


def rate(misses: DataFrame, rater: Callable[[str], str], attempts: int = 3, strict: bool = False, wait: Callable[[Exception], float] | None = None) -> DataFrame:
    """misses with label and failed; a rater that keeps failing gives neutral, or raises if strict.
    A worker holds one Arrow batch and SLICE prompts as strings, however large the input."""

    def one(prompt: str) -> tuple[str, bool]:
        for i in range(attempts):
            try:
                return rater(prompt), False
            except Exception as e:  # noqa: BLE001  a rater may fail in any way
                if i + 1 < attempts and wait:
                    time.sleep(wait(e))
                elif i + 1 == attempts and strict:
                    raise
        return "neutral", True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                got = [one(p) for p in part.column("prompt").to_pylist()]
                raw, failed = pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns, raw, failed], names=[*part.schema.names, "raw", "failed"])

    schema = misses.schema.simpleString()[7:-1].replace(":", " ") + ", raw string, failed boolean"
    return misses.mapInArrow(run, schema).withColumn("label", S.normalize_label(F.col("raw"))).drop("raw")


def label_texts(df: DataFrame, rater: Callable[[str], str] | None, provider: str = "none", model: str = "", cache: DataFrame | None = None, fallback: str | None = None, key: str = "doc_id", text: str = "text", attempts: int = 3, strict: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(df with label_prompt_1..3 and final_label, new cache rows).  Without a rater every
    prompt gets the fallback column's label, or neutral; strict then raises."""
    if rater is None:
        if strict:
            raise ValueError("strict labelling needs a rater")
        label = S.normalize_label(F.col(fallback)) if fallback else F.lit("neutral")
        out = df.withColumns({f"label_prompt_{i}": label for i in (1, 2, 3)})
        return out.withColumn("final_label", majority_vote(*[F.col(f"label_prompt_{i}") for i in (1, 2, 3)])), None
    keys = prompt_keys(df, provider, model, key, text)
    hits, misses = (keys.limit(0).withColumn("label", F.lit("")), keys) if cache is None else cached(keys, cache)
    # Only keys and prompts go to Python.
    once = written(rate(misses.select("cache_key", "prompt").dropDuplicates(["cache_key"]), rater, attempts, strict).select("cache_key", "label", "failed"))
    rated = misses.join(once.select("cache_key", "label"), "cache_key")
    every = hits.select(key, "prompt_no", "label").unionByName(rated.select(key, "prompt_no", "label"))
    wide = every.groupBy(key).pivot("prompt_no", [1, 2, 3]).agg(F.first("label"))
    for i in (1, 2, 3):
        wide = wide.withColumnRenamed(str(i), f"label_prompt_{i}")
    out = df.join(wide, key, "left").withColumn("final_label", majority_vote(*[F.col(f"label_prompt_{i}") for i in (1, 2, 3)]))
    return out, once.where("not failed").select("cache_key", "label")  # fallbacks are not cached
