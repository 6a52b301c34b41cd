"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.shared import clear as clear_written  # noqa: F401
from textloom.sources.shared import read_table, written  # noqa: F401

#: Words are maximal runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Row keys up to which a set of them is broadcast (16 bytes each); larger sets join by shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows of a join key from which it is split.
HOT_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bounds Arrow batches by bytes, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """Evaluates value once and binds it in body, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def attach(rows: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column], salt: str) -> DataFrame:
    """rows with aggregates of their key group.  Groups are summed and joined by
    (key, salt), with the salt drawn from a column that differs within a group, so
    that a hot group is never in one task."""
    n = max(16, shuffle_partitions(rows.sparkSession))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(n)))
    part = salted.groupBy(*keys, "__salt").agg(*[c.alias(k) for k, c in partial.items()])
    whole = part.groupBy(*keys).agg(*[c.alias(k) for k, c in final.items()])
    by_salt = part.select(*keys, "__salt").join(whole, keys)
    return salted.join(by_salt, [*keys, "__salt"]).drop("__salt")


def spread_join(rows: DataFrame, side: DataFrame, key: str, by: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """rows joined with side, which has one row a key.  ``counted`` is a written table with the
    keys of rows, by default rows itself.

    Keys with more than ``HOT_ROWS`` rows are split by a salt drawn from column ``by``, and
    their row of side is copied once for each ``HOT_ROWS`` rows, so that no key is one task's."""
    most = max(16, shuffle_partitions(rows.sparkSession))
    hot = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS)
    hot = written(hot.select(key, F.least(F.ceil(F.col("__n") / HOT_ROWS), F.lit(most)).cast("int").alias("__n")))
    n = hot.count()
    if n == 0:
        return rows.join(side, key, how)
    hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    cut = F.coalesce("__n", F.lit(1))
    salted = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), cut)).drop("__n")
    copies = side.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), cut - 1).cast("array<bigint>"))).drop("__n")
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def row_key() -> dict[str, Column]:
    """128 bits that name a row by its doc_id and text; rows that agree in both are interchangeable."""
    return {f"__k{i}": F.xxhash64(F.lit(i), F.col("doc_id").cast("long"), F.col("text").cast("string")) for i in (1, 2)}


def keep_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs (all columns) that stay, by groups(__k1, __k2, kept) of those that may go.

    Keys without a kept row go; of rows that share a kept row's key one stays.  Only keys are
    joined and the texts stay where they are: the two sets of keys are broadcast up to
    ``BROADCAST_KEYS``, and beyond that joined by shuffle.
    """
    keys = ["__k1", "__k2"]
    tagged = docs.select(F.struct("*").alias("__row"), *[c.alias(k) for k, c in row_key().items()])
    per = written(groups.groupBy(*keys).agg(F.max("kept").alias("any"), F.count("*").alias("n")))
    lost, ties = per.where("not any").select(keys), per.where("any and n > 1").select(keys)
    small = lambda d: F.broadcast(d) if d.count() <= BROADCAST_KEYS else d
    lost, ties = small(lost), small(ties)
    rest = tagged.join(lost, keys, "left_anti")
    once = rest.join(ties, keys, "left_semi").groupBy(*keys).agg(F.first("__row").alias("__row"))
    return rest.join(ties, keys, "left_anti").select("__row.*").unionByName(once.select("__row.*"))
