"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from textloom.operators.models import predict
from textloom.operators.serve import prepared


def read_files(spark: SparkSession, path: str, schema, glob: str = "*.parquet", **options) -> DataFrame:
    """A file-source stream over Parquet files as they arrive."""
    return spark.readStream.schema(schema).options(pathGlobFilter=glob, **options).parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Processes what there is and stops: appends to a Parquet store, exactly once a file."""
    rows = transform(stream) if transform else stream
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def score_stream(stream: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """Stateless scoring: pred_label and confidence of each arriving row."""
    return predict(prepared(stream, text), model).drop("clean", "tokens")


def dedup_stream(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """An extension: drops repeats of a key within a watermark; the store itself never deduplicates."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
