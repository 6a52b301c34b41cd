"""Agreement, confusion matrices, metrics and error analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.scalars import LABELS, VOTE_LABELS, normalize_label

NEGATION_WORDS = ["not", "no", "never", "without", "cant", "can't", "dont", "don't", "none"]


def majority_vote(*raters: Column) -> Column:
    """The label that most raters gave; neutral where two lead together."""
    votes = {v: reduce(lambda a, b: a + b, [F.when(r == v, 1).otherwise(0) for r in raters]) for v in VOTE_LABELS}
    out = F.lit("neutral")
    for v in VOTE_LABELS:
        rest = [x for k, x in votes.items() if k != v]
        out = F.when((votes[v] > rest[0]) & (votes[v] > rest[1]), F.lit(v)).otherwise(out)
    return out


def fleiss_kappa(df: DataFrame, raters: list[str]) -> DataFrame:
    """One row: n_items, p_bar, p_e and kappa; 0.0 for no items, under two raters or p_e = 1."""
    n = len(raters)
    counts = [reduce(lambda a, b: a + b, [F.when(normalize_label(F.col(r)) == v, 1).otherwise(0) for r in raters]).alias(f"n{i}") for i, v in enumerate(VOTE_LABELS)]
    agree = (sum(F.col(f"n{i}") * F.col(f"n{i}") for i in range(3)) - n) / float(max(1, n * (n - 1)))
    sums = df.select(*counts).agg(F.count("*").alias("n_items"), F.avg(agree).alias("p_bar"), *[F.sum(f"n{i}").alias(f"s{i}") for i in range(3)])
    p_e = sum(F.pow(F.try_divide(F.col(f"s{i}").cast("double"), F.col("n_items") * float(n)), F.lit(2.0)) for i in range(3))
    out = sums.select("n_items", F.coalesce("p_bar", F.lit(0.0)).alias("p_bar"), F.coalesce(p_e, F.lit(0.0)).alias("p_e"))
    kappa = F.when((F.col("n_items") == 0) | F.lit(n < 2) | (F.abs(1 - F.col("p_e")) < 1e-12), 0.0).otherwise((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e")))
    return out.withColumn("kappa", kappa)


def confusion(df: DataFrame, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(true_label, pred_label, n) over the full label grid; unknown labels count as neutral."""
    by = by or []
    known = lambda c: F.when(F.col(c).isin(LABELS), F.col(c)).otherwise("neutral")
    counts = df.groupBy(*by, known(true).alias("true_label"), known(pred).alias("pred_label")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in LABELS for b in LABELS], "true_label string, pred_label string")  # nine rows
    grid = df.select(*by).distinct().join(F.broadcast(pairs)) if by else pairs
    return grid.join(counts, [*by, "true_label", "pred_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(label, support, precision, recall, f1) from a confusion table; 0 / 0 is 0."""
    by = by or []
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    rows = cm.select(*by, F.col("true_label").alias("label"), F.lit(1).alias("t"), F.col("n"), (F.col("true_label") == F.col("pred_label")).alias("hit"))
    cols = cm.select(*by, F.col("pred_label").alias("label"), F.lit(0).alias("t"), F.col("n"), F.lit(False).alias("hit"))
    s = rows.unionByName(cols).groupBy(*by, "label").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("t")).alias("support"), F.sum(F.col("n") * (1 - F.col("t"))).alias("predicted"))
    p, r = safe(F.col("tp"), F.col("predicted")), safe(F.col("tp"), F.col("support"))
    out = s.select(*by, "label", "support", "tp", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def metrics(cm: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and support-weighted precision, recall and F1 over the three fixed classes."""
    by = by or []
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    weighted = [safe(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return per_class(cm, by).groupBy(*by).agg(safe(F.sum("tp"), F.sum("support")).alias("accuracy"), *[(F.sum(m) / len(LABELS)).alias(f"macro_{m}") for m in ("precision", "recall", "f1")], *weighted)


def confusion_pairs(df: DataFrame, true: str, pred: str, k: int = 10) -> DataFrame:
    """The k most frequent (true, predicted) pairs of misclassified rows."""
    wrong = df.where(normalize_label(F.col(true)) != normalize_label(F.col(pred)))
    out = wrong.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("pred_label")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "true_label", "pred_label").limit(k)


def misclassified(df: DataFrame, true: str, pred: str, clip: dict[str, int] | None = None) -> DataFrame:
    """Rows whose normalised labels differ; long text columns are clipped for display."""
    out = df.where(normalize_label(F.col(true)) != normalize_label(F.col(pred)))
    return out.withColumns({c: F.substring(c, 1, n) for c, n in (clip or {}).items() if c in df.columns})


def has_negation(text: Column) -> Column:
    return F.arrays_overlap(F.split(F.coalesce(text, F.lit("")), r"\s+"), F.array(*map(F.lit, NEGATION_WORDS)))


def error_patterns(wrong: DataFrame, text: str = "clean_text") -> DataFrame:
    """One row: n_misclassified, short-text threshold max(6, p25), shares of short and negated texts."""
    rows = wrong.select(has_negation(F.col(text)).alias("neg"), F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).alias("n"))
    cut = rows.agg(F.greatest(F.lit(6), F.floor(F.coalesce(F.percentile("n", F.lit(0.25)), F.lit(0.0)))).cast("long").alias("cut"))  # one row
    return rows.join(F.broadcast(cut), how="right").groupBy("cut").agg(F.count("n").alias("n_misclassified"), F.coalesce(F.avg((F.col("n") <= F.col("cut")).cast("int")), F.lit(0.0)).alias("pct_short"), F.coalesce(F.avg(F.col("neg").cast("int")), F.lit(0.0)).alias("pct_has_negation")).withColumnRenamed("cut", "short_text_threshold_tokens")


def conclusion(summary: dict, pairs: list) -> str:
    """A short text from error_patterns' row and the leading pairs; says what the data say."""
    lines = ["Error analysis", f"Misclassified samples analyzed: {summary['n_misclassified']}"]
    lines.append(f"Most errors are true '{pairs[0]['true_label']}' predicted as '{pairs[0]['pred_label']}'." if pairs else "There are no errors.")
    if pairs:
        short = summary["pct_short"]
        lines.append(f"{short:.0%} of the errors are short texts (at most {summary['short_text_threshold_tokens']} tokens).")
        lines.append(f"{summary['pct_has_negation']:.0%} of the errors contain an explicit negation" + (": negation matters." if summary["pct_has_negation"] >= 0.3 else ": negation isn't what drives them."))
    return "\n".join(lines)


def best_of(df: DataFrame, score: str, order: str) -> DataFrame:
    """The row with the highest score; the first in order wins ties."""
    return df.orderBy(F.desc_nulls_last(score), order).limit(1)


def accepted(best: float | None, dummy: float | None, factor: float = 1.2) -> bool:
    """True where best reaches factor times dummy; a missing or NaN score never does."""
    return best is not None and dummy is not None and best == best and dummy == dummy and best >= factor * dummy
