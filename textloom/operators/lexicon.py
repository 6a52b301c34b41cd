"""Lexicon classifiers with negation, and a rule-based polarity scorer."""

from __future__ import annotations

import json
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.scalars import margin_label
from textloom.sources.shared import written

# The negators and how many tokens each reaches.
NEGATORS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nowhere", "hardly", "barely", "without", "n't"]
SCOPE = 3
#: Rows of a lexicon up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def _dimension(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast where the checked size allows, else left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scored_fold(tokens: Column, polarity, negators: list[str] | None = None, scope: int = SCOPE) -> Column:
    """struct(pos, neg): a fold over a token array.  polarity maps a token Column to -1, 0 or 1."""
    neg = NEGATORS if negators is None else negators
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("neg"), F.lit(0).alias("left"))

    def step(acc: Column, t: Column) -> Column:
        p = polarity(t) * F.when(acc["left"] > 0, -1).otherwise(1)
        off = t.isin(neg)
        return F.struct(
            (acc["pos"] + F.when(~off & (p > 0), 1).otherwise(0)).alias("pos"),
            (acc["neg"] + F.when(~off & (p < 0), 1).otherwise(0)).alias("neg"),
            F.when(off, scope).otherwise(F.greatest(acc["left"] - 1, F.lit(0))).alias("left"),
        )

    return F.aggregate(tokens, start, step)


def with_scope(df: DataFrame, key: str, tokens: str, negators: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """(key, pos, token, flipped): non-negation tokens; flipped where the latest negator is at most
    scope back.  A row looks back in its own array, so tokens are neither shuffled nor sorted."""
    neg = NEGATORS if negators is None else negators
    off = lambda t: F.coalesce(t.isin(neg) & (F.trim(t) != ""), F.lit(False))

    def seen(t: Column, i: Column) -> Column:
        flipped = reduce(lambda a, b: a | b, (off(F.get("__t", i - d)) for d in range(1, scope + 1)), F.lit(False))
        return F.when((F.trim(t) != "") & ~t.isin(neg), F.struct(i.alias("pos"), t.alias("token"), flipped.alias("flipped")))

    rows = df.select(key, F.col(tokens).alias("__t"))
    return rows.select(key, F.explode(F.array_compact(F.transform("__t", seen))).alias("__x")).select(key, "__x.*")


def ratio(pos: Column, neg: Column) -> Column:
    return F.coalesce(F.try_divide((pos - neg).cast("double"), (pos + neg).cast("double")), F.lit(0.0))


def lexicon_predict(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", tokens: str = "tokens", margin: float = 0.05, negators: list[str] | None = None) -> DataFrame:
    """(key, pos, neg, score, label) from lexicon(word, polarity); a word in both lists is positive."""
    words = _dimension(lexicon.groupBy("word").agg(F.max("polarity").alias("polarity")))
    hits = with_scope(df, key, tokens, negators).join(words, F.col("token") == F.col("word"))
    p = F.when(F.col("flipped"), -F.col("polarity")).otherwise(F.col("polarity"))
    sums = hits.groupBy(key).agg(F.count_if(p > 0).alias("pos"), F.count_if(p < 0).alias("neg"))
    out = df.select(key).join(sums, key, "left").select(key, F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    score = ratio(F.col("pos"), F.col("neg"))
    return out.withColumns({"score": score, "label": margin_label(score, margin)})


def synset_predict(df: DataFrame, synsets: DataFrame, key: str = "doc_id", tokens: str = "tokens", margin: float = 0.05, senses: int = 3, negators: list[str] | None = None) -> DataFrame:
    """(key, score, label) from synsets(lemma, rank, pos_score, neg_score): a token scores the
    mean of its first senses, a document the mean of its scored tokens."""
    per = synsets.where(F.col("rank") <= senses).groupBy("lemma").agg(F.avg(F.col("pos_score") - F.col("neg_score")).alias("s"))
    hits = with_scope(df, key, tokens, negators).join(_dimension(per), F.col("token") == F.col("lemma"))
    mean = hits.groupBy(key).agg(F.avg(F.when(F.col("flipped"), -F.col("s")).otherwise(F.col("s"))).alias("score"))
    out = df.select(key).join(mean, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.withColumn("label", margin_label(F.col("score"), margin))


# Degree words and the constants of the published rules.
BOOSTERS = ["very", "really", "extremely", "absolutely", "completely", "highly", "incredibly", "totally", "so"]
DAMPENERS = ["slightly", "somewhat", "barely", "hardly", "marginally", "partly", "kinda"]
DEGREE, CAPITALS, NEGATED = 0.293, 0.733, -0.74
FADE = (1.0, 0.95, 0.9)  # a degree word one, two, three words before
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
EXCLAIM, MOST_EXCLAIM = 0.292, 4
QUESTION, MOST_QUESTION, MANY_QUESTIONS = 0.18, 3, 0.96


def emphasis(text: Column) -> Column:
    """What exclamation marks (up to four) and repeated question marks add to a text's sum."""
    marks, asks = F.regexp_count(text, F.lit("!")), F.regexp_count(text, F.lit(r"\?"))
    return F.least(marks, F.lit(MOST_EXCLAIM)) * EXCLAIM + F.when(asks <= 1, 0.0).when(asks <= MOST_QUESTION, asks * QUESTION).otherwise(MANY_QUESTIONS)


#: Words of a valence lexicon up to which it is a literal that each row looks its own words up in.
LITERAL_WORDS = 100_000
_LIFTS = BOOSTERS + DAMPENERS


def _buckets(rows: list[tuple[str, float]]):
    """A lookup of a word's valence: maps of a few words each in an array by CRC, as Spark searches a map from end to end."""
    n = max(1, len(rows) // 2)
    maps: list[dict[str, float]] = [{} for _ in range(n)]
    for word, x in rows:
        maps[zlib.crc32(word.encode()) % n][word] = x
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,double>>")
    return lambda low: F.try_element_at(F.get(table, F.pmod(F.crc32(F.encode(low, "UTF-8")), F.lit(n)).cast("int")), low)


def _weighted(at: Column, w: Column, low: Column, mixed: Column, but: Column, valence: Column) -> Column:
    """What the word at position at (from 0) of the words w adds; low has them in lower case, but is the first "but" (from 1; 0: none)."""
    loud = lambda x: mixed & (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1)
    back = lambda d: (F.get(w, at - d), F.get(low, at - d))

    def degree(d: int) -> Column:
        x, y = back(d)
        step = F.when(y.isin(BOOSTERS), DEGREE).when(y.isin(DAMPENERS), -DEGREE)
        return F.coalesce(step + F.when(loud(x), F.signum(step) * CAPITALS).otherwise(0.0), F.lit(0.0)) * FADE[d - 1]

    v = valence + F.signum(valence) * (F.when(loud(F.get(w, at)), CAPITALS).otherwise(0.0) + degree(1) + degree(2) + degree(3))
    negated = reduce(lambda a, b: a | b, (F.coalesce(back(d)[1].isin(NEGATORS), F.lit(False)) for d in (1, 2, 3)))
    v = v * F.when(negated, NEGATED).otherwise(1.0)
    return F.coalesce(v * F.when((but == 0) | (at + 1 == but), 1.0).when(at + 1 < but, BUT_BEFORE).otherwise(BUT_AFTER), F.lit(0.0))


def with_polarity(df: DataFrame, valence: DataFrame, text: str = "text", alpha: float = 15.0, idioms: list[tuple[str, float]] | None = None) -> DataFrame:
    """df with neg, neu, pos and compound: rule scores after Hutto and Gilbert (2014) with a
    pluggable valence(word, valence) and idioms (lower-case phrase, valence), which count as one word.

    Capitals in a mixed-case text strengthen a word; a degree word among the three words
    before it strengthens or weakens it, the less the further away; a negator among these
    three turns it; what stands before the first "but" counts half and what stands after it
    one and a half times; exclamation and repeated question marks strengthen the sum.
    compound = s / sqrt(s * s + alpha).  An empty text gives (0, 1, 0, 0).

    A text is scored in its own row: its words never become rows and nothing is shuffled.  Only
    a lexicon of over LITERAL_WORDS words, or one that repeats words, is joined with the words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    for phrase, _ in idioms or []:
        body = F.regexp_replace(body, r"(?i)(?<![\p{L}\p{N}'_])" + r"\s+".join(phrase.split()) + r"(?![\p{L}\p{N}'_])", phrase.replace(" ", "_"))
    words = valence.select(F.col("word").alias("low"), F.col("valence").cast("double").alias("valence")).where("low is not null and valence is not null")
    if idioms:
        words = words.unionByName(df.sparkSession.createDataFrame([(p.replace(" ", "_"), float(x)) for p, x in idioms], "low string, valence double"))
    words = words.where(~F.col("low").isin(_LIFTS))  # degree words have no valence of their own
    kept = df.columns
    raw = df.withColumn("__w", F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}'_]+"), F.lit(0)))
    raw = raw.withColumn("__low", F.transform("__w", F.lower))
    mixed = F.exists("__w", lambda x: x == F.lower(x)) & F.exists("__w", lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1))
    w, low, weigh = F.col("__w"), F.col("__low"), lambda i, x: _weighted(i, w, low, F.col("__mixed"), F.col("__but"), x)
    listed = words.limit(LITERAL_WORDS + 1).collect()
    if len({r.low for r in listed}) == len(listed) <= LITERAL_WORDS:
        find = _buckets([(r.low, r.valence) for r in listed])
        at = F.array_compact(F.transform("__low", lambda t, i: F.when(t.isin([r.low for r in listed]), F.struct(i.alias("i"), t.alias("t"))))) if listed else F.array().cast("array<struct<i:int,t:string>>")
        rows = raw.withColumns({"__mixed": mixed, "__but": F.array_position("__low", "but"), "__at": at})
        rows = rows.withColumn("__v", F.transform("__at", lambda p: weigh(p["i"], find(p["t"]))))
    else:
        raw = written(raw.withColumns({"__mixed": mixed, "__but": F.array_position("__low", "but"), "__id": F.monotonically_increasing_id()}))
        hits = raw.select("__id", "__w", "__low", "__mixed", "__but", F.posexplode("__low").alias("__i", "low")).join(_dimension(words), "low")
        hits = hits.select("__id", weigh(F.col("__i"), F.col("valence")).alias("__x")).groupBy("__id").agg(F.collect_list("__x").alias("__v"))
        rows = raw.join(hits, "__id", "left").withColumn("__v", F.coalesce("__v", F.array().cast("array<double>")))
    add = lambda f: F.aggregate("__v", F.lit(0.0), lambda a, x: a + f(x))
    rows = rows.select(*kept, emphasis(F.coalesce(F.col(text), F.lit(""))).alias("__amp"), (F.size("__w") - F.size(F.filter("__v", lambda x: x != 0))).alias("__z"), F.size("__w").alias("__n_words"), add(lambda x: x).alias("__s"), add(lambda x: F.when(x > 0, x + 1).otherwise(0.0)).alias("__p"), add(lambda x: F.when(x < 0, 1 - x).otherwise(0.0)).alias("__n"))
    amp, p, n = F.col("__amp"), F.col("__p"), F.col("__n")
    sums = rows.select(*kept, "__z", "__n_words", (F.col("__s") + F.signum("__s") * amp).alias("__s"), (p + F.when(p > n, amp).otherwise(0.0)).alias("__p"), (n + F.when(n > p, amp).otherwise(0.0)).alias("__n"))
    total, s = F.col("__p") + F.col("__n") + F.col("__z"), F.col("__s")
    scores = {"neg": (F.col("__n") / total, 0.0), "neu": (F.col("__z") / total, 1.0), "pos": (F.col("__p") / total, 0.0), "compound": (s / F.sqrt(s * s + alpha), 0.0)}
    return sums.select(*[c for c in kept if c not in scores], *[F.when(F.col("__n_words") > 0, x).otherwise(empty).alias(c) for c, (x, empty) in scores.items()])


def polarity_scores(df: DataFrame, valence: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 15.0, idioms: list[tuple[str, float]] | None = None) -> DataFrame:
    """(key, neg, neu, pos, compound) of each row by with_polarity."""
    return with_polarity(df.select(key, text), valence, text, alpha, idioms).drop(text)
