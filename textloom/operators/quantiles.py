"""Exact medians by group without a group's values in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, n, name): the exact median of the group's values, as a double; nulls and NaNs don't count.

    A mergeable quantile sketch brackets the two middle ranks (its rank error is at most
    n / ACCURACY, the bracket is twice that wide); counts of distinct values then give the
    ranks inside the bracket exactly, so only its values meet in one window.  Null keys form
    a group; a group without values has no row.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    eps = 2 / ACCURACY
    box = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("__v", [0.5 - eps, 0.5 + eps], ACCURACY).alias("__q"))
    box = box.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "n", F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi"))
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.lit(True))
    # Values below the bracket are summed by group; those inside keep their own row.
    inside = counts.join(box, same).where("__v <= __hi").withColumn("__at", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")))
    inside = inside.groupBy(*keys, "n", "__at").agg(F.sum("__c").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("__at")))
    ranked = inside.withColumn("__to", upto).where("__at is not null")
    first, second = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    hit = lambda k: F.when((F.col("__to") >= k) & (F.col("__to") - F.col("__c") < k), F.col("__at"))
    return ranked.groupBy(*keys, "n").agg(((F.max(hit(first)) + F.max(hit(second))) / 2).alias(name))
