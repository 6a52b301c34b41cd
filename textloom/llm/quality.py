"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` lists (measure, least, most) rows; ``compiled`` turns the table into
one Column, so a judged document costs one pass of built-in functions and no
shuffle.  Measures: lengths, symbol, stop-word and line ratios, and the base
counts of the op9 contract.

Defined results: a null or empty text has no words, fails the base and is not
kept; rows are judged one by one, so ties and repeated rows get equal verdicts;
an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WORD, let, table

#: Frequent function words of the corpus languages; two distinct ones mark prose.
STOP_WORDS = "the of and to a in is that for with de la le les que et en un une du des der die und das den von ein im mit el los las y del por se con no".split()
#: (measure, least, most); null means no bound. Fixed production thresholds.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.15),
    ("mark_ratio", None, 0.5),
    ("dup_line_ratio", None, 0.45),
    ("stop_words_short", 1.0, None),
    ("stop_words", 2.0, None),
]


def measures(text: Column) -> list[dict[str, Column]]:
    """Two layers of measures: the second refers to the first by name."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return [
        {"__t": t, "__words": words, "__lines": lines},
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(F.col("__t"), F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_repeat_words": repeat_words(F.col("__words")).cast("long"),
            "n_marks": F.regexp_count(F.col("__t"), F.lit(r"[!{}\\^~=]")).cast("long"),
            "n_stop_words": F.size(F.array_intersect(F.col("__words"), F.array(*[F.lit(f(w)) for w in STOP_WORDS for f in (str, str.capitalize)]))).cast("long"),
        },
    ]


def repeat_words(words: Column, k: int = 5) -> Column:
    """Words covered by k-word windows that occur at least twice in words."""
    n = F.size(words)
    at = F.sequence(F.lit(0), n - k)
    windows = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))

        def repeated(a: Column) -> Column:
            same = lambda x, y: F.coalesce(F.get(a, x)["s"] == F.get(a, y)["s"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda x: same(x, x + 1) | ((x > 0) & same(x, F.greatest(x - 1, F.lit(0)))))
            return F.sort_array(F.transform(twice, lambda x: F.get(a, x)["i"]))

        start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(k), i - acc["last"])).alias("n"))
        return let(ranked, lambda a: F.aggregate(repeated(a), start, step, lambda acc: acc["n"]))

    return F.when(n < k, F.lit(0)).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))


def compiled(rules=None) -> Column:
    """The threshold table as one Column that is true for documents that pass."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    ratio = {
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "mark_ratio": F.col("n_marks") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "stop_words_short": F.when(F.col("n_words") >= 50, F.col("n_stop_words")),
        "stop_words": F.when(F.col("n_words") >= 80, F.col("n_stop_words")),
    }
    ok = F.lit(True)
    for name, least, most in RULES if rules is None else rules:
        c = ratio.get(name, F.col(name) if name not in ratio else None)
        if least is not None:
            ok = ok & F.coalesce(c >= least, F.lit(True))
        if most is not None:
            ok = ok & F.coalesce(c <= most, F.lit(True))
    return ok


def judged(docs: DataFrame, rules=None) -> DataFrame:
    """docs with the measures, base_failed and kept.  The verdict refers to a function that
    is not deterministic, so that a filter on it stays above the projection: pushed below,
    it would put the word array's whole expression where the lambdas refer to the array."""
    first, second = measures(F.col("text"))
    out = docs.withColumns(first).withColumns(second)
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & compiled(rules) & (F.monotonically_increasing_id() >= 0)).drop("__t", "__words", "__lines")


def quality_filter(docs: DataFrame, rules=None) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    tagged = docs.select(F.struct("*").alias("__row"), F.col("text"))
    return judged(tagged, rules).where("kept").select("__row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{f(w)}'" for w in STOP_WORDS for f in (str, str.capitalize))
SQL_OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS l FROM d),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM s), range(0, 5) AS x(j) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(l) AS n_lines, len(regexp_extract_all(t, '[!{{}}\^~=]')) AS n_marks, len(list_distinct(list_filter(w, lambda x: list_contains([{_STOPS}], x)))) AS n_stop FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n BETWEEN 2.0 AND 12.0 AND n_symbols / n <= 0.15 AND n_marks / n <= 0.5 AND n_dup_lines / greatest(n_lines, 1) <= 0.45
  AND (n_words < 50 OR n_stop >= 1) AND (n_words < 80 OR n_stop >= 2) AS kept FROM b
"""
