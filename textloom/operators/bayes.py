"""Naive Bayes as aggregations: models are DataFrames of parameters, keyed by real labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def multinomial_fit(counts: DataFrame, labels: DataFrame, vocab: DataFrame, key: str = "doc_id", label: str = "label", alpha: float = 1.0) -> DataFrame:
    """(label, idx, log_prior, log_prob): unsmoothed priors, add-alpha feature probabilities.
    counts(key, idx, cnt) and labels(key, label) of the training rows; vocab(idx) all features."""
    n = labels.agg(F.count("*").alias("n_all"))
    prior = labels.groupBy(label).agg(F.count("*").alias("n")).join(F.broadcast(n)).select(label, F.log(F.col("n") / F.col("n_all")).alias("log_prior"))
    sums = counts.join(labels.select(key, label), key).groupBy(label, "idx").agg(F.sum("cnt").alias("c"))
    grid = prior.join(F.broadcast(vocab.select("idx")))  # classes x features, the size of the model
    full = grid.join(sums, [label, "idx"], "left").withColumn("c", F.coalesce("c", F.lit(0)) + alpha)
    total = F.sum("c").over(W.partitionBy(label))
    return full.select(label, "idx", "log_prior", F.log(F.col("c") / total).alias("log_prob"))


def multinomial_predict(counts: DataFrame, docs: DataFrame, model: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """(key, pred): the label with the highest log probability; ties by label."""
    prior = F.broadcast(model.select(F.col(label).alias("pred"), "log_prior").distinct())  # one row a class
    rows = counts.join(model.select(F.col(label).alias("pred"), "idx", "log_prob"), "idx").groupBy(key, "pred").agg(F.sum(F.col("cnt") * F.col("log_prob")).alias("s"))
    scored = docs.select(key).join(prior).join(rows, [key, "pred"], "left").select(key, "pred", (F.col("log_prior") + F.coalesce("s", F.lit(0.0))).alias("score"))
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "pred"))
    return scored.withColumn("__r", best).where("__r = 1").select(key, "pred")


def gaussian_fit(vectors: DataFrame, vec: str = "vec", label: str = "label", smoothing: float = 1e-8) -> DataFrame:
    """(label, i, mean, var, log_prior): population variance plus an absolute floor."""
    rows = vectors.select(label, F.posexplode(vec).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    stats = rows.groupBy(label, "i").agg(F.avg("x").alias("mean"), (F.var_pop("x") + smoothing).alias("var"), F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("i"))
    return stats.select(label, "i", "mean", "var", F.log(F.col("n") / total + 1e-12).alias("log_prior"))


def gaussian_predict(vectors: DataFrame, model: DataFrame, key: str, vec: str = "vec", label: str = "label") -> DataFrame:
    """(key, pred).  The model, classes x dimensions, becomes one row of class arrays, so a
    vector meets its classes inside one expression and nothing shuffles."""
    per = model.groupBy(label).agg(F.first("log_prior").alias("p"), F.array_sort(F.collect_list(F.struct("i", "mean", "var"))).alias("d"))
    one = per.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "p", "d"))).alias("classes"))
    log_2pi = 1.8378770664093453

    def score(c):
        terms = F.zip_with(F.col(vec), c["d"], lambda x, d: -0.5 * (log_2pi + F.log(d["var"]) + (x.cast("double") - d["mean"]) * (x.cast("double") - d["mean"]) / d["var"]))
        return c["p"] + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    scored = vectors.join(F.broadcast(one)).select(key, F.transform("classes", lambda c: F.struct(F.round(score(c), 6).alias("s"), c["label"].alias("label"))).alias("all"))
    best = F.aggregate("all", F.col("all")[0], lambda a, b: F.when(b["s"] > a["s"], b).otherwise(a))
    return scored.select(key, best["label"].alias("pred"))
