"""Tokens: extraction, stop words, stemming and the composed preprocessing steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.clean import basic_clean, full_clean

# Token pattern, word lists, suffixes and the analysis limit.
TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)?"
STOP_WORDS = """a an and are as at be been being by for from has have had he her hers him his i if in into is it its itself
me my myself no not of on or our ours ourselves she so that the their theirs them themselves then there these they this
those to too under up us very was we were what when where which while who whom why with you your yours yourself yourselves
will can could should would just than about after before also do does did done doing more most much many such only own
over out off once because during again further""".split()
CONTRACTION_ENDS = ["s", "t", "d", "ll", "m", "re", "ve", "y"]
NOISE = ["http", "https", "www", "com", "org", "net", "amp", "nbsp", "gt", "lt", "rt"]
SUFFIXES = ["ization", "ational", "fulness", "ousness", "iveness", "tional", "ing", "edly", "ed", "ly", "ies", "sses", "ment", "tion", "s"]
SUFFIXES_LONG = [*SUFFIXES[:6], "biliti", *SUFFIXES[6:]]
MAX_TOKENS = 350
VARIANTS = ("v1_basic", "v2_no_stop", "v3_stem")


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def keep_tokens(tokens: Column, drop: list[str] | None = None) -> Column:
    """Tokens of two characters or more that are not in drop."""
    if not drop:
        return F.filter(tokens, lambda t: F.length(t) > 1)
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(drop))


def stem(t: Column, suffixes: list[str] | None = None) -> Column:
    """Strips the first listed suffix that leaves three characters or more."""
    out = F.when(F.length(t) <= 3, t)
    for s in suffixes or SUFFIXES:
        base = F.substring(t, F.lit(1), F.length(t) - len(s))
        out = out.when(t.endswith(s) & (F.length(t) >= len(s) + 3), F.concat(base, F.lit({"ies": "y", "sses": "ss"}.get(s, ""))))
    return out.otherwise(t)


def stems(tokens: Column, suffixes: list[str] | None = None) -> Column:
    return F.transform(tokens, lambda t: stem(t, suffixes))


def variant(c: Column, name: str) -> Column:
    """Tokens of a text under one of the preprocessing variants."""
    tokens = tokenize(basic_clean(c))
    if name == "v1_basic":
        return keep_tokens(tokens)
    if name == "v2_no_stop":
        return keep_tokens(tokens, STOP_WORDS)
    if name == "v3_stem":
        return stems(keep_tokens(tokens, STOP_WORDS))
    raise ValueError(f"Unknown preprocessing variant: {name}")


def truncated(tokens: Column, n: int = MAX_TOKENS) -> Column:
    return F.slice(tokens, 1, n)


def analysis_tokens(c: Column, normalise: bool = True) -> dict[str, Column]:
    """The layers of full preprocessing, for select() in two steps: the clean text,
    then columns over it (named clean_text)."""
    clean = full_clean(c, normalise)  # no sentence ends are left, so dropping boilerplate sentences changes nothing here
    tokens = tokenize(F.col("clean_text"))
    kept = keep_tokens(tokens, STOP_WORDS + CONTRACTION_ENDS + NOISE)
    return {"clean_text": clean, "tokens": tokens, "tokens_no_stop": kept}


def preprocess(df, text: str, prefix: str = "", normalise: bool = True):
    """Adds clean_text, tokens, tokens_no_stop, stemmed_tokens, final_text and
    was_truncated_for_analysis, all prefixed, for the column text."""
    layers = analysis_tokens(F.col(text), normalise)
    p = prefix
    df = df.withColumn(p + "clean_text", layers["clean_text"])
    df = df.withColumn(p + "tokens", tokenize(F.col(p + "clean_text")))
    df = df.withColumn(p + "tokens_no_stop", keep_tokens(F.col(p + "tokens"), STOP_WORDS + CONTRACTION_ENDS + NOISE))
    df = df.withColumn("__stems", stems(F.col(p + "tokens_no_stop"), SUFFIXES_LONG))
    return df.withColumns({
        p + "stemmed_tokens": truncated(F.col("__stems")),
        p + "final_text": F.array_join(truncated(F.col("__stems")), " "),
        p + "was_truncated_for_analysis": F.size("__stems") > MAX_TOKENS,
    }).drop("__stems")
