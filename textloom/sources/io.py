"""Sources and sinks: CSV, JSON, word lists, embeddings, run folders, cumulative store."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions.clean import strip


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; empty where it is missing."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Headed CSV with a declared schema; texts may hold line breaks and doubled quotes.  An empty
    field is null and a quoted empty one the empty text: Spark takes both for null unless its mark
    for nulls, here one that no text has, is another than the empty text."""
    options = {"header": True, "multiLine": True, "escape": '"', "nullValue": uuid.uuid4().hex, "emptyValue": ""}
    return spark.read.schema(schema).options(**options).csv(path)


def read_csv_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An empty table where the file is missing; a damaged file raises, so that a later write can't lose it."""
    return read_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; array columns become space-joined texts."""
    flat = [F.array_join(c, " ").alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    keep = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*flat).write.mode(mode).options(**keep).csv(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON report; None where it is missing or not a JSON object."""
    if not exists(spark, path):
        return None
    try:
        value = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small report, UTF-8, indent 2."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(json.dumps(value, indent=2, ensure_ascii=False, default=str).encode())
    out.close()


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): trimmed, lower-cased, distinct; blank lines and ; comments left out."""
    lines = spark.read.text(path).select(F.lower(strip(F.regexp_replace("value", "�", ""))).alias("word"))
    return lines.where((F.col("word") != "") & ~F.col("word").startswith(";")).distinct()


def embeddings(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(word, vec) of a text file of vectors; lines of under three parts are skipped and, of
    repeated words, the last line counts."""
    lines = spark.read.text(path).select(F.split(strip(F.col("value")), r"\s+").alias("p"), F.monotonically_increasing_id().alias("at"))
    rows = lines.where(F.size("p") >= 3).select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, 1_000_000), lambda x: x.cast("double")).alias("vec"), "at")
    if wanted is not None:
        rows = rows.join(wanted.select("word").distinct(), "word", "left_semi")
    return rows.groupBy("word").agg(F.max_by("vec", "at").alias("vec"))


def dimension(vectors: DataFrame, default: int = 50) -> int:
    row = vectors.select(F.size("vec").alias("n")).first()
    return row.n if row else default


def latest_run(spark: SparkSession, path: str, prefix: str = "run_", suffix: str = "") -> str | None:
    """The last run folder by name; one that ends with suffix is preferred."""
    runs = [n for n in list_dir(spark, path) if n.startswith(prefix)]
    preferred = [n for n in runs if suffix and n.endswith(suffix)]
    names = preferred or runs
    return f"{path}/{names[-1]}" if names else None


def latest_with(spark: SparkSession, path: str, child: str, prefix: str = "run_") -> str | None:
    """The newest run folder that holds child."""
    for n in reversed([n for n in list_dir(spark, path) if n.startswith(prefix)]):
        if exists(spark, f"{path}/{n}/{child}"):
            return f"{path}/{n}/{child}"
    return None


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name: old columns first, new ones appended, missing values null."""
    return old.unionByName(new, allowMissingColumns=True)


def stamped(df: DataFrame, run_id: str, ingested_at: str) -> DataFrame:
    """Adds the run id and ingestion time where a dataset lacks them."""
    new = {c: F.lit(v) for c, v in (("source_run_id", run_id), ("ingested_at_utc", ingested_at)) if c not in df.columns}
    return df.withColumns(new) if new else df


def append_to_store(datasets: dict[str, DataFrame], run_id: str, ingested_at: str, path: str) -> dict[str, dict[str, int]]:
    """Appends each dataset to its cumulative Parquet table; schemas evolve by name and
    nothing is rewritten or deduplicated.  Returns row and column counts by dataset."""
    out = {}
    for name, df in datasets.items():
        spark = df.sparkSession
        at = f"{path}/{name}"
        before = spark.read.option("mergeSchema", True).parquet(at).count() if exists(spark, at) else 0
        rows = stamped(df, run_id, ingested_at)
        rows.write.mode("append").parquet(at)
        store = spark.read.option("mergeSchema", True).parquet(at)
        after = store.count()
        out[name] = {"existing_rows": before, "incoming_rows": after - before, "final_rows": after, "columns_count": len(store.columns)}
    return out


def read_store(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{path}/{name}")


def run_totals(stats: dict[str, dict[str, int]]) -> int:
    return sum(s["final_rows"] for s in stats.values())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(align, frames)


def run_id(now) -> str:
    """A run id such as 20240131T235959Z from a UTC datetime."""
    return now.strftime("%Y%m%dT%H%M%SZ")


def write_run(datasets: dict[str, DataFrame], run: str, path: str) -> None:
    """One Parquet table a dataset, partitioned by run_id; readers prune to the runs they ask for."""
    for name, df in datasets.items():
        df.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def read_latest_run(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of the last run of a dataset."""
    runs = [n.split("=", 1)[1] for n in list_dir(spark, f"{path}/{name}") if n.startswith("run_id=")]
    df = spark.read.parquet(f"{path}/{name}")
    return df.where(F.col("run_id") == max(runs)) if runs else df


def preferred_first(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns first, where present, the others after in their order."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def text_column(df: DataFrame, choice: str | None = None) -> str:
    """The column of a text variant (v1, v2, v3) or a literal name; without a choice
    processed_text where there is one, else text."""
    if choice is None:
        return "processed_text" if "processed_text" in df.columns else "text"
    name = {"v1": "v1_basic_text", "v2": "v2_no_stop_text", "v3": "v3_stem_text"}.get(choice, choice)
    for c in (name, f"{name}_text"):
        if c in df.columns:
            return c
    raise ValueError(f"no text column for {choice!r}")
