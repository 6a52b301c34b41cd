"""Collection from tables: ranked terms, news and post search, enrichment, dedup, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.functions.clean import safe_text, strip
from textloom.operators.lexicon import _dimension, with_polarity
from textloom.operators.quantiles import medians
from textloom.sources.shared import written

#: The terms used where no source gives any.
DEFAULT_TERMS = ["Artificial Intelligence", "Climate Change", "Elections", "Technology", "Sports"]


def trend_terms(candidates: DataFrame, limit: int = 10, fallback: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(trend_term, trend_rank, geo) from candidates(region_order, geo, position, term): the
    first region with terms wins, then its first terms by position."""
    first = candidates.where("term is not null").agg(F.min("region_order").alias("first"))
    rows = candidates.where("term is not null").join(F.broadcast(first), F.col("region_order") == F.col("first"))
    out = rows.orderBy("position").limit(limit).withColumn("trend_rank", F.row_number().over(W.orderBy("position")).cast("long")).select(F.col("term").alias("trend_term"), "trend_rank", "geo")
    if out.isEmpty():
        if strict:
            raise ValueError("no source gave a trend term")
        terms = (DEFAULT_TERMS if fallback is None else fallback)[:limit]
        return candidates.sparkSession.createDataFrame([(t, i, "GLOBAL") for i, t in enumerate(terms, 1)], "trend_term string, trend_rank long, geo string")
    return out


def news_for_terms(news: DataFrame, page_size: int = 5, order: str = "relevance") -> DataFrame:
    """news rows with article_rank: the page_size most relevant of each term."""
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc_nulls_last(order), "url"))
    return news.withColumn("article_rank", rank.cast("long")).where(F.col("article_rank") <= page_size)


def first_seen(posts: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in order; null keys form a group."""
    return posts.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def search_posts(posts: DataFrame, limit: int = 100, n_sorts: int = 3) -> DataFrame:
    """posts(term, subreddit, sort_order, position, post_id, ...): at most
    max(1, limit // n_sorts) per term, subreddit and sort mode, each post once by first mode."""
    per = max(1, limit // n_sorts)
    top = F.row_number().over(W.partitionBy("term", "subreddit", "sort_order").orderBy("position"))
    return first_seen(posts.withColumn("__k", top).where(F.col("__k") <= per).drop("__k"), ["term", "subreddit", "post_id"], ["sort_order", "position"])


def search_fallback(posts: DataFrame, query: str, limit: int = 100, subreddits: list[str] | None = None) -> DataFrame:
    """Literal, case-insensitive search in title, selftext and search_query; best scores first."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower(safe_text(F.col("title"))), q) | F.contains(F.lower(safe_text(F.col("selftext"))), q) | F.contains(F.lower(safe_text(F.col("search_query"))), q)
    rows = posts.where(hit)
    if subreddits:
        rows = rows.where(F.lower("subreddit").isin([s.lower() for s in subreddits]))
    score = S.lenient_int(F.col("score").try_cast("double"))
    return rows.withColumn("score", score).orderBy(F.desc("score"), "post_id").limit(limit)


def search_terms(posts: DataFrame, terms: DataFrame, limit: int = 100, text: str = "text", key: str = "doc_id", score: str = "score") -> DataFrame:
    """The best posts that contain each term of terms(term), a stated query set: posts are
    read once and each tests all terms in one expression; hits meet no other post."""
    rows = [r.term for r in terms.select("term").distinct().limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("a query set has at most 10,000 terms")
    low = F.lower(safe_text(F.col(text)))
    found = F.filter(F.array(*[F.lit(t) for t in rows]), lambda t: F.contains(low, F.lower(t))) if rows else F.array().cast("array<string>")
    hits = posts.select(key, score, F.explode(found).alias("term"))
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc_nulls_last(score), key))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)


#: Columns of a post that enrichment passes on, with their types; absent ones become null.
PASSED = {"trend_rank": "long", "upvote_ratio": "double", "is_self": "boolean", "over_18": "boolean", "locked": "boolean", "stickied": "boolean", "url": "string", "permalink": "string", "search_sort": "string"}
#: The 34 columns of an enriched post, in order.
ENRICHED = """term trend_rank post_id subreddit title selftext score num_comments engagement upvote_ratio is_self over_18 locked stickied created_utc
created_datetime_utc created_day_of_week_utc created_hour_utc url permalink search_sort title_char_len selftext_char_len text_char_len has_selftext
term_in_title term_in_selftext news_count_for_term related_news_titles compound neg neu pos sentiment_label""".split()


def enrich(posts: DataFrame, news: DataFrame | None = None, label: Column | None = None, valence: DataFrame | None = None) -> DataFrame:
    """Cleaned title and body, engagement, dates, lengths, flags, the term's news, and with
    valence(word, valence) the polarity of title and body and its label."""
    title, body = strip(safe_text(F.col("title"))), strip(safe_text(F.col("selftext")))
    out = posts.withColumns({"title": title, "selftext": body, "score": S.lenient_int(F.col("score")), "num_comments": S.lenient_int(F.col("num_comments"))})
    ts = S.epoch_timestamp(F.col("created_utc"))
    out = out.withColumns({
        "engagement": F.col("score") + F.col("num_comments"),
        "created_datetime_utc": S.iso_utc(ts),
        "created_day_of_week_utc": S.weekday_name(ts),
        "created_hour_utc": F.hour(ts),
        "title_char_len": F.length("title"),
        "selftext_char_len": F.length("selftext"),
        "text_char_len": F.length(strip(F.concat_ws(" ", "title", "selftext"))),
        "has_selftext": F.length("selftext") > 0,
        "term_in_title": S.term_in(F.col("title"), F.col("term")),
        "term_in_selftext": S.term_in(F.col("selftext"), F.col("term")),
    })
    if news is not None:
        per = news.groupBy("term").agg(F.count("*").alias("news_count_for_term"), F.transform(F.array_sort(F.collect_list(F.struct("article_rank", "title"))), lambda s: s["title"]).alias("related_news_titles"))
        # The terms that have news are few: beside them the posts, texts and all, don't move.
        out = out.join(_dimension(written(per)), "term", "left").withColumns({"news_count_for_term": F.coalesce("news_count_for_term", F.lit(0)), "related_news_titles": F.coalesce("related_news_titles", F.array().cast("array<string>"))})
    if valence is not None:
        out = with_polarity(out.withColumn("__text", strip(F.concat_ws(" ", "title", "selftext"))), valence, "__text").drop("__text")
        out = out.withColumn("sentiment_label", S.threshold_label(F.col("compound")))
    return out if label is None else out.withColumn("sentiment_label", label)


def enriched_columns(df: DataFrame) -> DataFrame:
    """The 34 columns of an enriched post; a null is_self counts as false."""
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in PASSED.items() if c not in df.columns})
    return out.withColumn("is_self", F.coalesce("is_self", F.lit(False))).select(*ENRICHED)


def dedup_enriched(df: DataFrame) -> DataFrame:
    return first_seen(df, ["term", "subreddit", "post_id"], [F.desc_nulls_last("engagement"), F.desc_nulls_last("created_utc")])


def dedup_raw(df: DataFrame) -> DataFrame:
    return first_seen(df, ["term", "subreddit", "post_id"], [F.desc_nulls_last("score"), F.desc_nulls_last("created_utc")])


def _summary(df: DataFrame, key: str, measures: list[Column]) -> DataFrame:
    """One row a key, null kept.  Each key is joined with its exact median engagement."""
    out = df.groupBy(key).agg(F.count("post_id").alias("posts"), *measures, F.avg("compound").alias("avg_compound"), F.avg("engagement").alias("avg_engagement"))
    middle = medians(df, [key], "engagement", "median_engagement").select(F.col(key).alias("__key"), "median_engagement")
    return out.join(middle, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def term_summary(df: DataFrame) -> DataFrame:
    """One row a term, null kept; medians are exact."""
    is_ = lambda v: F.count_if(F.col("sentiment_label") == v).alias(f"{v}_posts")
    out = _summary(df, "term", [F.min("trend_rank").alias("trend_rank"), F.countDistinct("subreddit").alias("subreddits"), *map(is_, ("positive", "neutral", "negative"))])
    cols = ["term", "trend_rank", "posts", "subreddits", "avg_compound", "avg_engagement", "median_engagement", "positive_posts", "neutral_posts", "negative_posts"]
    return out.select(cols).orderBy(F.asc_nulls_last("trend_rank"), F.desc("posts"), F.asc_nulls_last("term"))


def subreddit_summary(df: DataFrame) -> DataFrame:
    out = _summary(df, "subreddit", [F.countDistinct("term").alias("terms")])
    return out.select("subreddit", "posts", "terms", "avg_compound", "avg_engagement", "median_engagement").orderBy(F.desc("posts"), F.asc_nulls_last("subreddit"))
