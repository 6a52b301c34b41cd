"""Scalar functions: labels, lenient numbers, dates, keys and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.clean import safe_text, strip

LABELS = ["negative", "neutral", "positive"]  # metric order
VOTE_LABELS = ["positive", "neutral", "negative"]
#: The three labelling prompts.
PROMPTS = [
    "Classify sentiment of this political text as one label only: positive, negative, or neutral. Return only one word.\nText: {text}",
    "You are labeling public opinion sentiment in political discourse. Choose exactly one label: positive / negative / neutral. Return one word only.\nText: {text}",
    "Sentiment task: decide whether tone toward topic is positive, negative, or neutral. Output only one of: positive, negative, neutral.\nText: {text}",
]
PROMPT_CHARS = 2500


def normalize_label(c: Column) -> Column:
    """Any text with "pos" is positive, else with "neg" negative, else neutral."""
    t = F.lower(strip(safe_text(c)))
    return F.when(F.contains(t, F.lit("pos")), "positive").when(F.contains(t, F.lit("neg")), "negative").otherwise("neutral")


def threshold_label(c: Column, positive: float = 0.05, negative: float = -0.05) -> Column:
    return F.when(c >= positive, "positive").when(c <= negative, "negative").otherwise("neutral")


def margin_label(score: Column, margin: float = 0.05) -> Column:
    return F.when(F.abs(score) < margin, "neutral").when(score > 0, "positive").otherwise("negative")


def encode_label(c: Column) -> Column:
    return F.when(c == "negative", 0).when(c == "positive", 2).otherwise(1)


def decode_label(c: Column) -> Column:
    return F.when(c == 0, "negative").when(c == 2, "positive").otherwise("neutral")


def lenient_int(c: Column, default: int = 0) -> Column:
    """A whole number, truncated toward zero; what doesn't parse becomes the default."""
    return F.coalesce(c.try_cast("bigint"), F.lit(default).cast("bigint"))


def epoch_timestamp(c: Column) -> Column:
    return F.timestamp_seconds(c.try_cast("double"))


def iso_utc(ts: Column) -> Column:
    """ISO text with offset; microseconds only where they are not zero."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def term_in(text: Column, term: Column) -> Column:
    """Case-insensitive literal containment; false for an empty term."""
    low = F.lower(safe_text(term))
    return (low != "") & F.contains(F.lower(safe_text(text)), low)


def prompt(c: Column, template: str) -> Column:
    before, after = template.split("{text}")
    return F.concat(F.lit(before), F.substring(safe_text(c), 1, PROMPT_CHARS), F.lit(after))


def cache_key(provider: Column, model: Column, prompt_: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("::", provider, model, prompt_), "UTF-8"), 256)


def softmax_confidence(scores: Column) -> Column:
    """Largest softmax share of an array of scores, shifted by its maximum."""
    top = F.array_max(scores)
    return F.lit(1.0) / F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))


def binary_confidence(score: Column) -> Column:
    p = F.lit(1.0) / (1 + F.exp(-score))
    return F.greatest(p, 1 - p)


def improvement(best: Column, dummy: Column) -> Column:
    return (F.try_divide(best, dummy) - 1) * 100


def percent_text(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "n/a").otherwise(F.format_string("%.2f%%", c * 100))
