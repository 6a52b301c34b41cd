"""The folder that driver and executors share, and what a run writes there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a single machine
    (master local or local[n]) and an error on a cluster, whose executors would not see it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return _LOCAL[app]


def _path(spark: SparkSession, at: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def run_dir(spark: SparkSession) -> str:
    """This application's own subfolder; Spark's JVM deletes it when it ends."""
    at = f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"
    fs, p = _path(spark, at)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return at


def fresh(spark: SparkSession, name: str = "t") -> str:
    """A path in the run's folder that nothing else uses."""
    return f"{run_dir(spark)}/{name}_{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application wrote, and drops its tables; results that are still
    to be read depend on both."""
    for t in spark.catalog.listTables():
        if t.name.startswith("textloom_") and t.tableType == "EXTERNAL":
            spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
    fs, p = _path(spark, run_dir(spark))
    fs.delete(p, True)


def written(df: DataFrame, bucket_by: str | None = None, buckets: int = 0) -> DataFrame:
    """Writes df as Parquet to the run's folder and reads it back: the lineage is cut, and
    the rows survive the loss of any executor.  Bucketed rows can be grouped by bucket_by
    without a shuffle."""
    spark = df.sparkSession
    path = fresh(spark)
    if bucket_by:
        name = "textloom_" + path.rpartition("_")[2]
        df.write.bucketBy(buckets, bucket_by).option("path", path).saveAsTable(name)
        return spark.table(name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Tables under half a file split of Spark's default size are one row group, often, and so one task.
SMALL_BYTES = 64 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a small one in fewer files than there are cores is dealt to all cores, as
    its row groups are fewer than these.  Other tables have splits enough and don't move."""
    df = spark.read.parquet(path)
    fs, p = _path(spark, path)
    cores = spark.sparkContext.defaultParallelism
    if fs.getContentSummary(p).getLength() < SMALL_BYTES and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
