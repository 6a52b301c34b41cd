"""Serving: single predictions, batch export, model files."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.clean import serving_clean
from textloom.functions.scalars import normalize_label
from textloom.functions.tokens import tokenize
from textloom.operators.evaluate import misclassified
from textloom.operators.models import predict
from textloom.sources.shared import written


class BadRequest(ValueError):
    """The text is empty after cleaning (status 400)."""


class NoModel(RuntimeError):
    """There is no model to serve (status 500)."""


def prepared(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("clean", serving_clean(F.col(text))).withColumn("tokens", F.filter(tokenize(F.col("clean")), lambda t: F.length(t) > 1))


def predict_one(spark: SparkSession, model: PipelineModel | None, text: str) -> dict:
    """{"sentiment", "confidence"} of one text."""
    if model is None:
        raise NoModel("no model is loaded")
    df = prepared(spark.createDataFrame([(text,)], "text string"))
    if df.first().clean == "":
        raise BadRequest("text is empty after cleaning")
    row = predict(df, model).first()
    return {"sentiment": row.pred_label, "confidence": row.confidence}


def export(df: DataFrame, model: PipelineModel, label: str = "label", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(all rows with pred_label, confidence and is_correct; the misclassified ones)."""
    out = predict(prepared(df, text), model).drop("clean", "tokens")
    # Written, as a filter on a prediction would repeat the whole model for each mention of the label.
    out = written(out.withColumn("is_correct", normalize_label(F.col(label)) == F.col("pred_label")))
    return out, misclassified(out, label, "pred_label")


def low_confidence(df: DataFrame, least: float = 0.45) -> DataFrame:
    return df.withColumn("low_confidence", F.coalesce(F.col("confidence") < least, F.lit(False)))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
